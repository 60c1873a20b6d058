"""Readers and writers of dense binary files and record files."""
