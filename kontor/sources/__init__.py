"""Recorded payloads of each source as businesses of one schema."""
