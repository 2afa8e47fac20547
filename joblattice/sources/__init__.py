"""Readers and writers for requests, listings, pages and the stored tables."""
