"""Streams of query points against stored tables."""
