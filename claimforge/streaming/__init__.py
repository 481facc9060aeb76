"""Watching: saved searches and snapshots as streams."""
