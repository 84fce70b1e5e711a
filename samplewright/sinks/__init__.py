"""Writers: image tables, ordered batches, blob shards, archives, run files."""
