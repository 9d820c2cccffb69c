"""Crystal-structure, band-representation and topological-index analytics on Spark DataFrames."""

__version__ = "0.1.0"
