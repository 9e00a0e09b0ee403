"""A PySpark-native analytics library: feature selection on discretized tables, and training-data operators."""
