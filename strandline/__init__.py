"""strandline: analytics over append-only conversation logs, built on Spark DataFrames."""

__version__ = "0.1.0"
