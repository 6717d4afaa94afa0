"""Logweave sources."""
