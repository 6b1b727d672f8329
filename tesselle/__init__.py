"""tesselle: rasters, ordered signals, point sets and small graphs as Spark DataFrames."""

__version__ = "0.1.0"
