"""Scoring operators (score), partitioning and resources (resources),
measurement (measure)."""
