"""The query language: text -> statements -> DataFrames."""

from weftgraph.lang.runner import Session

__all__ = ["Session"]
