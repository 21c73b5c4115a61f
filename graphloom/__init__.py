"""Property-graph and retrieval analytics as PySpark DataFrame plans."""
