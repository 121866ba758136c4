"""Whole-document flows and the views derived from the warehouse tables."""
