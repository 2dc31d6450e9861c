"""spliceflow: retargeting analytics for corpora of event-indexed series, on Spark DataFrames."""

__version__ = "0.1.0"
