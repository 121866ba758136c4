"""DataFrame operators: filters, layout, analysis, validation, results, metrics."""
