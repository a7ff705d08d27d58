"""Readers of pages, seeds and requests; writers of messages."""
