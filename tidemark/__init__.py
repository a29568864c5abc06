"""Tidemark: point-in-time analytics over nested activity logs, as Spark jobs."""

__version__ = "0.1.0"
