"""rollweave: analytics over model-rollout and text-corpus data on Spark DataFrames."""

__version__ = "0.1.0"
