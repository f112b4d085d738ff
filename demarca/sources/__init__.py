"""Readers, fixed lookups, writers and stored summaries."""
