"""Readers and file-corpus jobs."""
