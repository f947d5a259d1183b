"""Reads that arrive continuously."""
