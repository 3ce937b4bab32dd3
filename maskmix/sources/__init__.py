"""Datasets from files and tables."""
