"""Column functions: text, measurements, geometry."""
