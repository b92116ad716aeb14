"""Scoring of documents as they arrive."""
