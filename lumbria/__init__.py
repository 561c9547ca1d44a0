"""lumbria: a Spark-native engine for place recommendation and usage analytics."""

__version__ = "0.1.0"
