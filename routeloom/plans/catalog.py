"""The registry of queries: name, Spark plan, and DuckDB twin.

A plan applies an operator of the library to the driver's tables, which stand for the data of a routing dataset:
``part`` is the catalog of skills, ``orders`` the queries, ``lineitem`` the relevance judgements, ``embeddings`` the
vectors, ``events`` the training log, ``customer`` with ``nation`` and ``region`` a taxonomy.
"""

from __future__ import annotations

from routeloom.plans import codes, curation, documents, graphs, joins, logs, ranking, splits, summaries, text, validation
from routeloom.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "MODULES"]

MODULES = (codes, curation, documents, graphs, joins, logs, ranking, splits, summaries, text, validation)
FLAGSHIP = "couse_edges"
