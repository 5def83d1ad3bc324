"""Scores as SQL text, for the functions of the SQL surface."""

from __future__ import annotations

from ..functions import vocabulary as V


def band_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} <= {most} THEN '{name}'" for most, name in V.GRADE_BANDS) + " ELSE 'F' END"
