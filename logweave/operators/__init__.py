"""Logweave operators."""
