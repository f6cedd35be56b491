"""Spark jobs for protein data at scale: alignments, contacts, model activations, records.

Jobs take DataFrames and parameters and return DataFrames.
"""
