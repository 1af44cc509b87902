"""Reusable plan shapes and whole query flows composed from the operators."""
