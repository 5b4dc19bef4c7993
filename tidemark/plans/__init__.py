"""Composed evaluations (L1-L5, J13) and the query registry."""
