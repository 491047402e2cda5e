"""Survey-microdata and labour-market tables as lazy Spark DataFrames."""

from surveyloom.operators.design import LinearDesign, ReplicateDesign
from surveyloom.operators.measures import Block, mean, median, total

__all__ = ["Block", "LinearDesign", "ReplicateDesign", "mean", "median", "total"]
