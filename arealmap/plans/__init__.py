"""Whole cartograms: relational steps around per-map solvers."""
