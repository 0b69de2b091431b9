"""eventloom: index-dated cohorts, windowed features and model evaluation on Spark DataFrames."""

__version__ = "0.1.0"
