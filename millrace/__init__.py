"""Millrace: time-series, feature and corpus operators as Spark DataFrame jobs."""

__version__ = "0.1.0"
