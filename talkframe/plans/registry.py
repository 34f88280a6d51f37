"""Every query of the conversation engine, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from talkframe.plans import changes, evidence, exchanges, exports, layer, mining, profile, review, scalars, sessions, shown, streams  # noqa: F401  (they register)
from talkframe.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
