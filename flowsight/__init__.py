"""Spark jobs that spot data leaving a network inside DNS and DNS-over-HTTPS traffic."""

__version__ = "0.1.0"
