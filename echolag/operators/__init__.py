from . import (
    components,
    domains,
    edit_log,
    grouping,
    interest,
    merge,
    mining,
    periodicity,
    rollup,
    snapshot_diff,
    statistics,
    support,
    sweep,
    timeline,
    validation,
)

__all__ = [
    "components",
    "domains",
    "edit_log",
    "grouping",
    "interest",
    "merge",
    "mining",
    "periodicity",
    "rollup",
    "snapshot_diff",
    "statistics",
    "support",
    "sweep",
    "timeline",
    "validation",
]
