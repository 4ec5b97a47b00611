"""maskwright: a PySpark-native text de-identification analytics engine."""
