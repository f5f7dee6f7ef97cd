"""Relational operators on activity, session and window tables."""
