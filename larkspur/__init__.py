"""larkspur: a PySpark-native engine for retrieval, code-graph and memory analytics."""
