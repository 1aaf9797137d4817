"""Registered queries over the test tables, with their SQL."""

from . import control, registry  # noqa: F401  (control adds its queries to the registry)
