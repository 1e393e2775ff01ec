"""All registered queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from sievework.plans import breadth, core, evaluation, streams  # noqa: F401  (they register themselves)
from sievework.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "t_chunk_stats"
