"""Readers and writers of the store file formats."""
