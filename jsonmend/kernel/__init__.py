"""The repair kernel: pure Python on one document, without any Spark import."""
