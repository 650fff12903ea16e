"""Operators for preparing training text: screening, deduplication, extraction, packing, mixing and encoding."""
