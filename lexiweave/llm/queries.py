"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

import importlib

MODULES = ("bpe", "licenses", "cells", "fingerprints", "unigram", "packing", "line_dedup", "ngram_join", "quality", "url_filter")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"lexiweave.llm.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
