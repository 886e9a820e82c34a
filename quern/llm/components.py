"""Connected components of an edge table, without driver-side data: the library's alternating star contractions."""

from quern.operators.graph import contracted as components

__all__ = ["components"]
