"""Column functions: normalizers, parsers, similarities."""
