"""quarrykit: data preparation, profiling, text mining and model evaluation on Spark DataFrames."""

__version__ = "0.1.0"
