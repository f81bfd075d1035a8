"""Micro-batched ingest."""
