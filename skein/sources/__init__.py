"""Readers of external formats."""
