"""Operators for preparing training data: cleaning, deduplication, mixing, packing and the like."""
