"""Column functions: text, units, money, classification."""
