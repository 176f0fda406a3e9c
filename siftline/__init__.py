"""siftline: a PySpark analytics engine for postings, companies, events and text corpora."""

__version__ = "0.1.0"
