"""The registered queries and their SQL."""

from __future__ import annotations

from verdigris.queries import curation, ranking, records, registry, temporal, text  # noqa: F401  (they register themselves)
from verdigris.queries._registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
