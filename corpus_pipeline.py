"""Training-corpus pipeline over ``documents``; see README."""

from __future__ import annotations

from veritext.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
