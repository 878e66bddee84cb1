"""Column functions: text, arrays, hashing, numbers, skew."""
