"""Composed query plans and their registry."""
