"""Logweave functions."""
