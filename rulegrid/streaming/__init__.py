"""rulegrid.streaming."""
