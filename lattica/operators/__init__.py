"""Operators over distributed arrays."""
