"""All registered queries."""

from mensura.plans import (  # noqa: F401  (importing registers the queries)
    q_scans, q_guards, q_joins, q_aggregates, q_windows, q_functions, q_signal, q_tests, q_models, q_reports,
)
from mensura.plans.registry import ORACLES, QUERIES  # noqa: F401
