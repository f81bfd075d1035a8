"""Filters, metrics and compaction."""
