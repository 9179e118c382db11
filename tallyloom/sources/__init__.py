"""Readers, writers and the sales store."""
