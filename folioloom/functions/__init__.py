"""Folioloom functions."""
