"""Operators that take functions."""
