"""Operators for building training corpora; see the module of each operator."""
