"""Folioloom streaming."""
