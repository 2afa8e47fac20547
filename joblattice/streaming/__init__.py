"""Structured Streaming jobs; each shares its transform with a batch query."""
