"""evloom: a PySpark-native engine for evidence-grounded question-answering data."""

__version__ = "0.1.0"
