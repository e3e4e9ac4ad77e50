"""A Spark-native engine: static quality of declarative UI sources, and training-data operators."""
