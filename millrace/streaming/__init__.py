"""Incremental forms of the audit operators."""
