"""All queries and their SQL."""

from .plans import audit, build, content, index, journals, logs, rules, search, streams, surface

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in (search, index, build, logs, journals, audit, content, surface, rules, streams):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
