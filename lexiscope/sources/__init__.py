"""Readers, writers and fixture views."""
from lexiscope.sources.tables import table  # noqa: F401
