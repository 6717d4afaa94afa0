"""Logweave: analytics over event-sourced workflow runs, written for PySpark."""
