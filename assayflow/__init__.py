"""Peptide-assay analytics on Spark DataFrames."""
