"""Scalar and array functions as Column builders (and a few Arrow UDFs)."""
