"""A PySpark-native engine for batch SQL pipelines."""
