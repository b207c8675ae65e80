"""Imports every plan module so that the registry is complete."""

from tidelog.plans import auction_queries, check_queries, feature_queries, history_queries  # noqa: F401
from tidelog.plans import metric_queries, mixing_queries  # noqa: F401
from tidelog.plans import fitted_queries, gate_queries, scans, selection_queries, stat_queries  # noqa: F401
from tidelog.plans import stream_queries, within_queries  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES, SURVEY_IDS  # noqa: F401
