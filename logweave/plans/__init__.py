"""Logweave plans."""
