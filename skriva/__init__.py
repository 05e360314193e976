"""A Spark-native engine for document retrieval, evaluation and event stores."""

__version__ = "0.1.0"
