"""gazeflow: a Spark-native engine for sensor time series, interval events and study statistics."""

__version__ = "0.1.0"
