"""A Spark-native lexical search, ranking and corpus-processing engine."""

__version__ = "0.1.0"
