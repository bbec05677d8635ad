"""Scalar functions and vector codecs."""
