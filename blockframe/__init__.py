"""Block-structured, content-verified, randomly accessible archives as Spark DataFrames."""

__version__ = "0.1.0"
