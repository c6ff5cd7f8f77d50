"""Quality, drift, scoring and explanation of tabular flow data on Spark."""

__version__ = "0.1.0"
