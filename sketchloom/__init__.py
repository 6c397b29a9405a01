"""Spark jobs over corpora of diagram graphs, keyed by diagram."""
