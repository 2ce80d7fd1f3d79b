"""Audit analytics for spreadsheet-like models on Spark."""
