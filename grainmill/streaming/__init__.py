"""Structured Streaming form of the drift watch."""
