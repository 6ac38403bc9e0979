"""tickloom: technical analysis of bar series as Spark DataFrame transformations."""

__version__ = "0.1.0"
