"""tessera: Spark-native retrieval, graph and incremental-analytics operators."""
