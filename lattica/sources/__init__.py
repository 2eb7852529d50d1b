"""Readers, writers and random sources."""
