"""Column expressions over addresses, formulas and text."""
