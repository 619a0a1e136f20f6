"""Point-cloud analytics along a travelled path, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
