"""Families and folds at size: links and folds whose rows are not pairs."""

from emberline.operators import folds, graph


def test_block_links_make_the_families_of_all_pairs(spark):
    import random

    g = random.Random(3)
    for count, blocks in ((40, 12), (60, 3), (9, 30)):
        at = {f"n{k:02}": g.randrange(blocks) for k in range(count)}
        nodes = spark.createDataFrame(list(at.items()), "node string, b int")
        upper, lower = nodes.where("b % 4 <> 0").select("node", nodes.b.alias("block")), nodes.select("node", (nodes.b + 1).alias("block"))
        pairs = [(a, b) for a in at for b in at if at[a] == at[b] + 1 and at[a] % 4]
        links = graph.block_links(upper, lower)
        assert links.count() <= 2 * count
        want = graph.families(spark.createDataFrame(pairs, "src string, dst string"))
        assert {tuple(r) for r in graph.families(links).collect()} == {tuple(r) for r in want.collect()}


def test_family_queries_shuffle_no_pairs(spark):
    from emberline.queries import QUERIES, evidence

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().count()
    _, links = evidence.family_links(spark, "/root/testdata/sf0.01")
    assert links.count() <= 2 * rows
    edges = QUERIES["family_edges"](spark, "/root/testdata/sf0.01")
    edges.count()
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate [src" not in plan


def test_folds_of_threads_that_bar_families(spark):
    import random

    g = random.Random(4)
    for _ in range(3):
        held = {f"c{k:02}": sorted(g.sample(range(6), g.choice((1, 1, 2)))) for k in range(30)}
        links = [(f"c{g.randrange(30):02}", f"c{g.randrange(30):02}") for _ in range(12)]
        family = {c: c for c in held}
        for _ in range(30):
            for a, b in links:
                family[a] = family[b] = min(family[a], family[b])
        clips = spark.createDataFrame([(c, t, ts[0]) for c, ts in held.items() for t in ts] + [("z", None, None)], "clip string, thread int, fold_thread int")
        barred = {(t, family[c]) for c, ts in held.items() for t in ts}
        threads = {ts[0] for ts in held.values()}
        want = {(ts[0], c, "test") for c, ts in held.items()} | {(None, "z", "test")}
        want |= {(t, c, "train") for t in threads for c, ts in held.items() if t != ts[0] and (t, family[c]) not in barred}
        got = [tuple(r) for r in folds.grouped_folds(clips, spark.createDataFrame(links, "a string, b string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_block_pairs_against_loops(spark, monkeypatch):
    import random

    g = random.Random(5)
    for tile, run, named in ((4, 3, 10), (1000, 7, 25), (2, 100, 1000)):
        for name, value in (("TILE", tile), ("RUN", run), ("NAMED", named)):
            monkeypatch.setattr(graph, name, value)
        at = {f"n{k:02}": g.randrange(6) for k in range(60)}
        nodes = spark.createDataFrame([*at.items(), ("z", None)], "node string, b int")
        upper, lower = nodes.where("b % 4 <> 0").select("node", nodes.b.alias("block")), nodes.select("node", (nodes.b + 1).alias("block"))
        got = [tuple(r) for r in graph.block_pairs(upper, lower).collect()]
        want = {(a, b) for a in at for b in at if at[a] == at[b] + 1 and at[a] % 4 or at[b] == at[a] + 1 and at[b] % 4}
        assert len(got) == len(set(got)) and set(got) == want
    assert graph.block_pairs(upper.where("false"), lower).collect() == []


def test_family_edges_take_little_disk(spark, tmp_path):
    """The rows grow with the square of the contents: runs of one ``src`` and of few ``dst`` keep files short."""
    from emberline.queries import QUERIES

    docs = spark.range(24_000).selectExpr("id AS doc_id", "'x' || id AS text", "'en' AS lang", "'src1' AS source", "5 AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    QUERIES["family_edges"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 2_000_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * rows


def test_pairs_of_tiles_are_not_held_at_once(spark):
    """Explodes that Spark compiles into one loop (a star in the plan) hold all rows of one input row: at most a run's may be."""
    nodes = spark.range(40).selectExpr("string(id) AS node", "id % 2 AS block")
    pairs = graph.block_pairs(nodes, nodes.selectExpr("'l' || node AS node", "block"))
    assert len(pairs.collect()) == 2 * 2 * 20 * 20
    lines = [x.strip(" +-:") for x in pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()]
    near, = (x for x in lines if "Generate explode(transform(near" in x)
    run, = (x for x in lines if "Generate explode(run" in x)
    assert near.startswith("Generate") and run.startswith("*")
