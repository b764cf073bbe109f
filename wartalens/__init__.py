"""wartalens: topic analytics for news corpora, written as PySpark DataFrame jobs."""

__version__ = "0.1.0"
