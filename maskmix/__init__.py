"""Joint preparation of several datasets with partly overlapping keys, on Spark."""

__version__ = "0.1.0"
