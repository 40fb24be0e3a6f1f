"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import importlib

MODULES = ["substring", "toxicity", "bpe", "quality", "lines", "langid", "topk", "simhash", "lm", "mixing", "merkle", "whitening", "packing"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"pulseframe.llm.{m}"), name))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
