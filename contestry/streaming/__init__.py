"""Readiness and live refresh over arriving files."""
