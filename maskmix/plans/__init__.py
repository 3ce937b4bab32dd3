"""Epoch plans and the catalogue of queries."""
