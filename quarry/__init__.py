"""quarry: a PySpark-native engine for indexing and querying text and source-code corpora."""

__version__ = "0.1.0"
