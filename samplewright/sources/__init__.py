"""Readers: image tables, class folders, archives, blob shards, run files."""
