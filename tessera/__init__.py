"""tessera: a Spark-native engine for tabular machine-learning data work."""
