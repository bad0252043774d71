"""Readers, writers, harmonization and table adapters."""
