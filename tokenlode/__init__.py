"""Tokenlode: n-gram analytics over token corpora, planned by Spark."""

__version__ = "0.1.0"
