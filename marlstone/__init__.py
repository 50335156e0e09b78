"""marlstone: a PySpark-native analytics engine for object-lake data."""
