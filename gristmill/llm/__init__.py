"""Operators for building training corpora: scans, filters, near-duplicate search, mixing, sharding and packing."""
