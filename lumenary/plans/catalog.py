"""All queries on the driver's tables. Importing a module registers what it holds."""

from __future__ import annotations

from . import evaluation, evidence, graph, ingestion, operations, packs, passages, retrieval, tables, text, versions  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
