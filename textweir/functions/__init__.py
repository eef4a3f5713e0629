"""Column functions: text normalization and word distances."""
