"""Every registered query and, where SQL can say it, its SQL."""

from __future__ import annotations

from .plans import command_queries, more_queries, queries, session_queries

FLAGSHIP = "RNK03_score"
QUERIES = queries.QUERIES | session_queries.QUERIES | more_queries.QUERIES | command_queries.QUERIES
ORACLES = queries.ORACLES | session_queries.ORACLES | more_queries.ORACLES | command_queries.ORACLES
