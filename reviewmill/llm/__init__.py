"""Operators for preparing training data: archives, deduplication, packing, classification, scans, tokens, scores."""
