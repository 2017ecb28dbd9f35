"""Column functions: distances, vectors, text, Bloom filters."""
