"""Readers, catalogues and writers."""
