"""Column builders: vectors, text and scoring expressions."""
