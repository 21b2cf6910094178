"""PySpark-native engine for multi-source text catalogues."""
