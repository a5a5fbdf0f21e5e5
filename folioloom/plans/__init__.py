"""Folioloom plans."""
