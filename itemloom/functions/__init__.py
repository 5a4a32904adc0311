"""Column functions: text, time, order keys, typed cells, arrays."""
