"""Feeds in, and the audit log out."""
