"""Column functions: text, units and enumerations."""
