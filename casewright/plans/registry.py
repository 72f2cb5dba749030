"""All queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from . import candidate_queries, diagnostic_queries, evaluation_queries, masking_queries, report_queries, similarity_queries, sweep_queries  # noqa: F401  register their queries
from .more_queries import bca_interval
from .queries import ORACLES, QUERIES

#: Fitted by a corrected bootstrap, which a test holds against plain Python instead of SQL.
QUERIES["bca_interval"] = bca_interval

__all__ = ["ORACLES", "QUERIES"]
