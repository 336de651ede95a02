"""Comparative genomics on Spark: alignments and trees as DataFrames."""
