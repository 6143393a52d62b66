"""All queries of the library outside the language-model operators, with their oracle SQL."""

from __future__ import annotations

from corpusloom.plans import aggregate_plans, contract_plans, dedup_plans, privacy_plans, sampling_plans, source_plans, statistic_plans, text_plans  # noqa: F401
from corpusloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "agg_1"
