"""Composed queries and the catalogue of registered ones."""
