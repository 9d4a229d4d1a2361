"""Windowed stream joins and what surrounds them, as Spark jobs."""
