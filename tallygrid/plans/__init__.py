"""Registered checks, projections of tables onto the cell model, and the queries over them."""
