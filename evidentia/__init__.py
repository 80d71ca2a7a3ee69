"""Evidentia: entity resolution over multi-modal observations, on Spark."""

__version__ = "0.1.0"
