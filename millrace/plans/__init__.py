"""Queries over the driver's tables, with their oracle SQL."""
