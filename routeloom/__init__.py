"""routeloom: a PySpark-native engine for retrieval and routing datasets."""

__version__ = "0.1.0"
