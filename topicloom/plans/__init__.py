"""All registered queries."""

from topicloom.plans import (  # noqa: F401
    joins,
    operations,
    records,
    relational,
    scalars,
    streams,
    subjects,
    topics,
    windows,
)
from topicloom.plans.registry import ORACLES, QUERIES, runnable


def queries():
    return {name: runnable(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
