"""Composite jobs: datasets, model evaluation and reports."""
