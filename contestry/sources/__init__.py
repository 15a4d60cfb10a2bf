"""Readers, writers and the play-shaped view over star-schema tables."""
