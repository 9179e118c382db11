"""File-arrival trigger for uploads."""
