"""All queries of the core library, with their oracle SQL."""

from __future__ import annotations

from . import alignment, collections, derived, events, lexical, networks, reports, services, stores, text, writing  # noqa: F401  (they register themselves)
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
