"""A PySpark-native engine for document knowledge, retrieval and test-suite data."""
