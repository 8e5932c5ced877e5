"""Registered queries of the learner and corpus analytics and their SQL, gathered from the operator modules."""

from __future__ import annotations

from ..operators import calibration, content, curation, index, learning, lexicon, library, maintained, matching, proximity, psychometrics, quality, retrieval, signals, spatial, views

MODULES = (learning, psychometrics, curation, quality, retrieval, lexicon, content, signals, views, library, matching, spatial, index, calibration, maintained, proximity)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
