"""NumPy kernels that the per-row and per-map operators run inside Arrow or pandas functions."""
