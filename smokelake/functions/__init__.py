"""Column functions: boxes, geometry, text."""
