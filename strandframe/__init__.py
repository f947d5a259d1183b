"""Sequencing reads as DataFrames: validation, pairing, sampling, trimming and quality control on Spark."""
