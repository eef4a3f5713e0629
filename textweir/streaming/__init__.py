"""Matching and replay as structured streams."""
