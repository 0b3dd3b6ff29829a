"""Incremental forms of the append load and the prediction upsert."""
