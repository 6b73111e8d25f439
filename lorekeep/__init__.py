"""Governed-knowledge analytics on Spark: curate, re-check, retrieve, evaluate and report."""

__version__ = "0.1.0"
