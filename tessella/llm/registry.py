"""Queries opN_<name> of this package, the pipeline, and their oracle SQL."""

from __future__ import annotations

from . import rows_corpus, rows_pages, rows_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (rows_text, rows_pages, rows_corpus):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
