"""Folioloom operators."""
