"""Column functions: no UDF among them but the embedder's."""
