"""Checks and the algebra of their findings."""
