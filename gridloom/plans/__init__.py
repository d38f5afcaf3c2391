"""Compositions of operators into stages and whole batches."""
