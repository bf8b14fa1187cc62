"""Column builders and the distribution functions."""
