"""Readers, writers and the row id made at ingest."""
