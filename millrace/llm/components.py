"""Connected components of a link table: the library's own."""

from millrace.operators.graph import components

__all__ = ["components"]
