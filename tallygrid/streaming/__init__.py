"""Workbooks and findings as streams."""
