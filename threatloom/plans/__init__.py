"""End-to-end jobs made of the operators."""
