"""Numerical kernels of single frames, in numpy only."""
