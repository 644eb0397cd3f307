"""strandframe: short-read placement and sequence-data preparation as Spark jobs."""

__version__ = "0.1.0"
