"""Spectral libraries on Spark: digestion, prediction, compact libraries, retention times."""

__version__ = "0.1.0"
