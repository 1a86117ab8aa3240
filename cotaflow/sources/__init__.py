"""Reading daily reports, snapshots and lookup tables, and writing the consolidated tables."""
