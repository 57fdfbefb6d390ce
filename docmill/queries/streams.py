"""Batch forms of the streaming operators over ``events``."""

from __future__ import annotations

from docmill.registry import query
from docmill.plans.views import table


@query("t2_sliding_rate_limit")
def _(spark, sf):
    from docmill.streaming.rate_limit import rate_limit

    return rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", limit=3, seconds=86_400.0)
