"""Operators from DataFrames of reads or pairs to DataFrames."""
