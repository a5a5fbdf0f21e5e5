"""Folioloom sources."""
