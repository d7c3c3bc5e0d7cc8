"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import os

import duckdb
import pytest

from emberline.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_source_has_a_role(spark, tmp_path):
    """Null, longer and line-ended sources are queries; only src0 to src9 are references."""
    sources = ["src1", "src9", "src10", "src123", "src1\n", "other", "", None]
    docs = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}", "en", s, 4) for i, s in enumerate(sources * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["exact_shortcut"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(ORACLE_SQL["exact_shortcut"]).df())
    assert set(got["query"]) == {i for i, s in enumerate(sources * 2) if s not in ("src1", "src9")}
