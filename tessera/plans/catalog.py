"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from . import contracts, evidence, ranking, structure

QUERIES: dict = {**ranking.QUERIES, **structure.QUERIES, **evidence.QUERIES, **contracts.QUERIES}
ORACLE: dict[str, str] = {**ranking.ORACLE, **structure.ORACLE, **evidence.ORACLE, **contracts.ORACLE}
