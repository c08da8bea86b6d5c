"""Composed components."""
