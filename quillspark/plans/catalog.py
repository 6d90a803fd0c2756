"""All queries of the engine, without the training-data operators."""

from __future__ import annotations

from quillspark.plans import analytics, ingest, quality_loop, retrieval, streaming
from quillspark.plans.registry import QUERIES, SQL, fill_in

fill_in()

__all__ = ["QUERIES", "SQL", "analytics", "ingest", "quality_loop", "retrieval", "streaming"]
