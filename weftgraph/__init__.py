"""PySpark-native engine for requirement-style property graphs."""
