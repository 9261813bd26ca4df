"""Cartogram state over streams of values."""
