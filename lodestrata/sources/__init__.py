"""Readers: files, notes, transcripts, compiler indexes."""
