"""Loomstack: retrieval analytics and corpus building as PySpark DataFrame operators."""
