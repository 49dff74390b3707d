"""nearfield: text and dense-vector retrieval jobs written for Spark DataFrames."""

__version__ = "0.1.0"
