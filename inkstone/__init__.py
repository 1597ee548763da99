"""A PySpark-native engine for reading-oriented text corpora."""
