"""Column functions and fixed vocabularies."""
