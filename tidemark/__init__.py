"""tidemark: a PySpark-native change-impact analytics engine."""

__version__ = "0.1.0"
