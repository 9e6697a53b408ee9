"""Data work around machine-learning runs, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
