"""Readers of tables and GeoJSON documents."""
