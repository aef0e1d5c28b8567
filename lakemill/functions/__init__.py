"""Scalar functions of the dialect."""
