"""Readers, writers and catalogue level jobs."""
