"""wayspring: a Spark-native engine for scoped text retrieval and corpus analytics."""

__version__ = "0.1.0"
