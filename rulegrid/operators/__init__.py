"""rulegrid.operators."""
