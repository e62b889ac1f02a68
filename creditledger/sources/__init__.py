"""Readers and table schemas."""
