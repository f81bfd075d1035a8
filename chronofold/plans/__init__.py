"""Queries, their plans, and the text forms they can be written in."""
