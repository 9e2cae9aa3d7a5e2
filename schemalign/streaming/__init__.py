"""Incremental landing of new files."""
