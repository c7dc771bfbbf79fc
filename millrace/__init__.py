"""millrace: corpus building, checking and measuring on Spark DataFrames."""

__version__ = "0.1.0"
