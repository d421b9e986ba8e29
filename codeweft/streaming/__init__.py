"""Micro-batches of file listings."""
