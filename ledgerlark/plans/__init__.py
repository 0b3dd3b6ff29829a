"""Composed jobs: derived tables, registered queries and their SQL counterparts."""
