"""loomwork: a PySpark-native engine for dataset construction and evaluation."""
