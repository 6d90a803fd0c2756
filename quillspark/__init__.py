"""Multilingual search, search analytics and training-data preparation as Spark jobs."""
