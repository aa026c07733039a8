"""Column functions: sky cells, geometry, photometry."""
