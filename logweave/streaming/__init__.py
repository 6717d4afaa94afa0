"""Logweave streaming."""
