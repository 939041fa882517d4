"""Column functions: sequences, features and statistics."""
