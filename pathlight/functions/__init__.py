"""Scalar statistical kernels."""
