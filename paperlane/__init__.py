"""Document analytics as DataFrame-to-DataFrame steps on Spark SQL."""
