"""Relational forms of the sample operators."""
