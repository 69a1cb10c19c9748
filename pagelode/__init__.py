"""A PySpark-native analytics engine for document layout and text quality."""
