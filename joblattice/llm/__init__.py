"""Operators for training data: packing, filters, near-duplicates, media, scans."""
