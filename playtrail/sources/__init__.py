"""Readers, cleaning rules and writers."""
