"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from . import aggregates, bound, choice, domain, evaluation, flows, further, intake, joins, learn, live, masks, panels, relational, resampling, state, windowed  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
