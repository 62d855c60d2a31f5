"""Readers, admission of raw files and schema-on-read."""
