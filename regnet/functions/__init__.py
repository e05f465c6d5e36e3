"""Column functions: motif mathematics, sequences, names."""
