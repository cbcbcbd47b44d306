"""Readers, writers and the scratch folder."""
