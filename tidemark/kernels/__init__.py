"""Numerical kernels in numpy, free of Spark; grouped-map stages call them."""
