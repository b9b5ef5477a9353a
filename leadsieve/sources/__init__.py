"""Readers, schemas and the snapshot tables."""
