"""Continuous ingestion over the same operators."""
