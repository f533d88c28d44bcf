"""rulegrid.functions."""
