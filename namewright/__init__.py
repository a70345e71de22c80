"""namewright: a PySpark-native engine for identifier-rename analytics."""
