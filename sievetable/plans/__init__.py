"""Bounded read-only SQL over a prepared table and staged reuse."""
