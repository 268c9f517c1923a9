"""Column builders: geometry on the sphere and in the gnomonic plane, tags, text and JSON values."""
