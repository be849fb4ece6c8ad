"""loomdex: full-text search, curation and training-data operators on PySpark."""

__version__ = "0.1.0"
