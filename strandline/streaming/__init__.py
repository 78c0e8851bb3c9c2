"""Published snapshots and their incremental upkeep."""
