"""weftline: exact-match analytics over sequences and the labelled graphs they walk, as Spark jobs."""

__version__ = "0.1.0"
