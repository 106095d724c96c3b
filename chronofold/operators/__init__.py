"""Relational operators over the canonical tables."""
