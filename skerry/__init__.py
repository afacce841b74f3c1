"""skerry: a Spark-native SQL and data-processing engine."""

__version__ = "0.1.0"
