"""Column functions and DataFrame helpers shared by the operators."""
