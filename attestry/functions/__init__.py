"""Column functions: paths, text, digests and keys."""
