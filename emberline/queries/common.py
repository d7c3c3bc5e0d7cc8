"""Registration, and common table expressions of the SQL forms."""

from __future__ import annotations

FRAMES = """frames AS (
  SELECT user_id AS clip, event_id, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    count(*) OVER (PARTITION BY user_id) AS n,
    greatest(-90.0::DOUBLE, 10.0::DOUBLE * log10(greatest(value, 1e-9::DOUBLE))) AS level,
    CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 ELSE -1 END AS target
  FROM events)"""

BASED = FRAMES + """, based AS (
  SELECT *, quantile_cont(level, 0.5) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 60 PRECEDING AND 3 PRECEDING) AS baseline
  FROM frames), jumped AS (SELECT *, level - baseline AS jump FROM based)"""

WINDOWS = BASED + """, windows AS (
  SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, jump - 6.0::DOUBLE)))) AS p
  FROM jumped WHERE frame >= 22 AND frame < n - 5)"""

CLIPS = """clips AS (
  SELECT DISTINCT user_id AS clip, CASE WHEN user_id % 2 = 0 THEN 'positive' WHEN user_id % 5 = 0 THEN 'unlabeled' ELSE 'negative' END AS label, user_id % 7 AS thread
  FROM events)"""

MEDIA = """media AS (
  SELECT d.doc_id, '/' || lang || '/src/' || source || '/' || d.doc_id || '.mp4' AS path, d.doc_id || '.mp4' AS file, source AS thread,
    octet_length(encode(text))::BIGINT AS size, sha256(text) AS digest,
    CASE WHEN toxic = 1 THEN 'unlabeled' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' ELSE 'unlabeled' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TIER = "CASE WHEN {0} IS NULL OR isnan({0}) OR {0} < 0 OR {0} > 1 THEN 'unknown' WHEN {0} >= 0.8 THEN 'alert' WHEN {0} >= 0.6 THEN 'maybe' ELSE 'low' END"


def r(x: str, name: str) -> str:
    """Six decimals, as the engine rounds them."""
    return f"round({x}, 6) + 0.0::DOUBLE AS {name}"


class Registry:
    """Queries by name, with SQL where given."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
