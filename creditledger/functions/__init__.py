"""Column expressions: paths, lines, shares, ignore rules."""
