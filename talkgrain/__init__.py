"""Chat-message search and processing on Spark DataFrames."""

__version__ = "0.1.0"
