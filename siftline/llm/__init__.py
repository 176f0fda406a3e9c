"""Operators of a training-data pipeline; nothing else in siftline imports this subpackage."""
