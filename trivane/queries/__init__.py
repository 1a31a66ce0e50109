"""All registered queries of the core library; all but those of the op-log engine have SQL that must give the same rows."""

from __future__ import annotations

from . import algebra, engine, graph, push, session, solve, time

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (algebra, graph, push, time, solve, session, engine):
    QUERIES.update(_m.R.queries)
    ORACLES.update(_m.R.oracles)
