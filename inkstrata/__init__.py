"""Fingerprint analytics for text and source-code corpora on Spark."""
