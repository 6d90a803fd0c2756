"""Training-data operators: scoring, similarity joins, mixing, dedup, archives, formatting.

Nothing outside this folder imports it.
"""
