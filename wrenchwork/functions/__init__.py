"""Column functions: text, status classes and warranty cover."""
