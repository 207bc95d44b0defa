"""Readers and writers: text files, JSON lines, saved indexes."""
