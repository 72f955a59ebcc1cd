"""Named queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

PLANS: dict = {}
ORACLES: dict = {}


def plan(name: str, sql: str | None = None):
    """Register a query function, and the DuckDB statement for its rows if there is one."""

    def add(fn):
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


from sondage.plans import auditing, cohort, evaluation, linking, modelling, parsing, reports, resampling, screening  # noqa: E402, F401
