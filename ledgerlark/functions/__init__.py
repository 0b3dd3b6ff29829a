"""Column helpers and distributed ranking helpers."""
