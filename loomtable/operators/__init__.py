"""Operators on declared tables."""
