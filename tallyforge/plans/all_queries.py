"""Importing this module registers every query."""

from tallyforge.plans import (  # noqa: F401
    q_effort, q_matching, q_metrics, q_models, q_prep, q_recipes, q_runlog, q_sources, q_streaming, q_telemetry,
)
from tallyforge.plans.registry import ORACLES, QUERIES  # noqa: F401
