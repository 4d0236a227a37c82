"""cairnflow: a Spark-native engine for time-stamped transaction graphs."""

__version__ = "0.1.0"
