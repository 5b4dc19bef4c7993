"""Relational operators: ranks, pair joins, truth joins, contaminations,
detectors, metrics, votes, statistics and cleaning."""
