"""The registered queries and their SQL."""

from __future__ import annotations

from siftloom.plans import admission, arrays, auditing, details, edit_rules, evaluation, judging, kernels, logs, preference, ranking, receipts, scheduling, text_rules  # noqa: F401
from siftloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
