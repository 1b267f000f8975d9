"""Incremental jobs on file sources."""
