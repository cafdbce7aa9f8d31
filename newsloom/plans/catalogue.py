"""Every registered query of the core and, where SQL can say the same, its SQL."""

from __future__ import annotations

from newsloom.operators import timestamps
from newsloom.plans import company_queries, instants, news_queries, training_queries

QUERIES: dict = {"p2_found": timestamps.p2_found, **company_queries.Q, **news_queries.Q, **training_queries.Q}
ORACLES: dict = {"p2_found": instants.P2_FOUND, **company_queries.S, **news_queries.S, **training_queries.S}
