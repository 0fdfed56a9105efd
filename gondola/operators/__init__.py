"""Relational operators over the retail tables."""
