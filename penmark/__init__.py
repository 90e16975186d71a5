"""penmark: stylometric text analytics and machine-text detection on Spark DataFrames."""

__version__ = "0.1.0"
