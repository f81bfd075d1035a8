"""The partitioned store and newline-delimited JSON."""
