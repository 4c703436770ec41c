"""Readers, writers and input planning."""
