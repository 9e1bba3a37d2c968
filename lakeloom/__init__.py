"""lakeloom: composable PySpark operators for documents, conversations, vectors, events and tables."""

__version__ = "0.1.0"
