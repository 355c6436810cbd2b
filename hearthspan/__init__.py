"""Property-market analytics on Spark DataFrames."""

from hearthspan.session import get_spark

__all__ = ["get_spark"]
