"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import corpus, evaluation, figures, reports, runs, states

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (evaluation, corpus, figures, runs, reports, states):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
