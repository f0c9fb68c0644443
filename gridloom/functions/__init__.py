"""Column expressions: everything here is a Column in, a Column out."""
