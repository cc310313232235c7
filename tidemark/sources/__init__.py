"""Readers and writers of interval, table, sequence and alignment files."""
