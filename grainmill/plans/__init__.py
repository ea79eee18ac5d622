"""Ordered cleaning plans: built from findings, applied as one lazy plan."""
