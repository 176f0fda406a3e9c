"""siftline subpackage."""
