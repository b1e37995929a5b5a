"""Training-data operators: quality, dedup, extraction, tokenising, mixing and scans.

Nothing else in the library imports this subpackage.
"""
