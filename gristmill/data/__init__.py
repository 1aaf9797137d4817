"""Data that the package loads: word lists, as plain text."""
