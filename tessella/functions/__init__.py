"""Column functions with exact numerics and text rules."""
