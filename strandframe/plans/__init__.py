"""Whole runs over reads: from input to retained records and reports."""
