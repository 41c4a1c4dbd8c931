"""sluicebox: check, stress-test and audit data pipelines with Spark DataFrames."""

__version__ = "0.1.0"
