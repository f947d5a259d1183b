"""Where reads come from: FASTQ text, and reads derived from Parquet tables."""
