"""Merge, search, entity-resolution, scheduling and reporting operators on DataFrames."""
