"""Composite pipelines over several operators."""
