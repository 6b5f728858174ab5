"""Operators for preparing training text: filters, scans, dedup, sharding and packing."""
