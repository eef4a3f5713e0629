"""Lifetimes, similarity joins, matching and verification."""
