"""Readers and writers of the library's own formats."""
