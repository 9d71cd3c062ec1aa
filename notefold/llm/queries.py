"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from notefold.llm import families, frequency, language, leakage, overlap, packing, quota_sample

MODULES = [families, frequency, overlap, quota_sample, packing, leakage, language]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
