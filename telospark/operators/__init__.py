"""Operators on DataFrames: filters, interval joins, annotation, sampling, tests, models, motifs."""
