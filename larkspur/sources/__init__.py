"""Readers of repositories, transcripts and evaluation sets, and the snapshot store."""
