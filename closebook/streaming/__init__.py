"""Deduplication over unbounded feeds."""
