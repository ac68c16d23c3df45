"""Repository-corpus analytics as Spark DataFrame operators."""
