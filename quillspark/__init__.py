"""A PySpark-native analytics library for document-analysis and recognition data."""
