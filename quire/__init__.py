"""Quire: Spark jobs over versioned document corpora."""
