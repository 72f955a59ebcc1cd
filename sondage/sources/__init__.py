"""Readers and writers: strictly typed text tables, archives, checksums."""
