"""lexgraph: a Spark-native engine for knowledge graphs of statutory texts."""
