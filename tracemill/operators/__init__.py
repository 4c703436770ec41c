"""Relational operators over coverage rows and general tables."""
