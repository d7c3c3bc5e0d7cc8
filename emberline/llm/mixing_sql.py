"""DuckDB SQL that gives the rows of the mixing query over ``documents``."""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS level FROM totals
), rests AS (
  SELECT *,
    (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS rests
  FROM levels
  WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(3.0::DOUBLE * source_size, coalesce((SELECT arg_min(rests, level) FROM rests WHERE level >= rests), 'inf'::DOUBLE) * weight) AS target
  FROM rests
), placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS k,
    (('0x' || substr(md5('1:' || coalesce('=' || s.source, 'null')), 1, 7))::BIGINT::DOUBLE + 0.5) / 268435456.0::DOUBLE AS shift
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, (floor(k * rate + shift) - floor((k - 1) * rate + shift))::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM copied
"""
