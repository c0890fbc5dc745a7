"""Readers, writers and the derived input tables."""
