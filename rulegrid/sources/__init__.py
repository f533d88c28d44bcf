"""rulegrid.sources."""
