"""Loads every module that registers queries."""

from checks import fit_queries, judge_queries, pair_queries, score_queries, step_queries  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
