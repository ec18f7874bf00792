"""Analytics over trees of content-addressed nodes, on Spark DataFrames."""

__version__ = "0.1.0"
