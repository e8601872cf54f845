"""lectern: textbook-corpus analytics and hybrid retrieval on PySpark DataFrames."""

__version__ = "0.1.0"
