"""A PySpark-native engine for note/link graphs."""
