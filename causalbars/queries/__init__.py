"""Registered queries of the library's own operators, each with equivalent DuckDB SQL."""

from . import bars, evaluation, features, gates, joins, markets, models, stacking

QUERIES = {}
ORACLES = {}
for _module in (bars, features, joins, evaluation, markets, models, gates, stacking):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
