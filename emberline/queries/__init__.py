"""Registered queries of the engine's operators, each with its SQL where there is one."""

from __future__ import annotations

from . import evidence, ingest, joins, learning, recordings, timeline

QUERIES = {**ingest.QUERIES, **timeline.QUERIES, **evidence.QUERIES, **learning.QUERIES, **recordings.QUERIES, **joins.QUERIES}
ORACLE_SQL = {**ingest.SQL, **timeline.SQL, **evidence.SQL, **learning.SQL, **recordings.SQL, **joins.SQL}
