"""A PySpark-native engine for declaratively specified tables."""
