import re
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from emberline.llm import urls
from emberline.llm.queries import URL_RULES, op4_url_filters

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "https://a.example.com/en/8", "ftp://b.net/de/1", "x://example.net/de/81#f", "x://example.net/de/7", "http://é.ORG/es/?q", "http://com/en/", "http://notexample.com/en/7", "http://xcom/en/", "a://b://c.org/es/", "http://example.com?/en/", "http://u.org:80/es/", "http://" + "a." * 5000 + "com/en/x", "http://h\n.com/en/y"]


def brute(url):
    m = re.search(r"://", url or "")
    host, path = "", ""
    if m:
        rest = url[m.end() :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[1], best[2] if best else "allow"


def test_listed_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = urls.filter_urls(pages, none, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id])
    assert urls.filter_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_mined_rules(spark, monkeypatch):
    rows = [(f"http://{'bad' if i % 2 else 'good'}.site{i % 7}.info/{'pills' if i % 4 == 1 else 'news'}/{i}?id={i}", i % 4 == 1 or i % 50 == 0) for i in range(600)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(1000, None)], "page_id long, url string")
    want = {i: "block" if i % 4 == 1 and i < 600 else "allow" for i in [*range(600), 1000]}
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labelled, []).collect()}
    assert got == want
    # brute-force: rules are token sets with enough support and confidence
    seen = labelled.withColumn("h", urls.url_host(labelled.url)).withColumn("p", urls.url_path(labelled.url))
    seen = seen.withColumn("tokens", urls.url_tokens(seen.url, seen.h, seen.p))
    data = [(set(r.tokens), r.block) for r in seen.collect()]
    for r in urls.mine_rules(seen).collect():
        held = [b for t, b in data if set(r.antecedent) <= t]
        assert sum(held) >= 20 and abs(sum(held) / len(held) - r.confidence) < 1e-9 >= 0 and r.confidence >= 0.8 and r.anchor in r.antecedent
    # the join for many rules gives the same
    monkeypatch.setattr(urls, "LITERAL_RULES", 0)
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, labelled, []).collect()} == want


def test_tokens_of_the_whole_url(spark):
    deep = "/a/b/c/d/" + "e" * 500
    bad = ["http://x{i}.info" + deep + "/pills/{i}", "http://a.casino-win.b.c.e{i}.info/{i}", "http://y{i}.info/{i}?a=1&b=2&c=3&d=4&promo=5"]
    good = ["http://x{i}.info" + deep + "/news/{i}", "http://a.shop.b.c.e{i}.info/{i}", "http://y{i}.info/{i}?a=1&b=2&c=3&d=4&id=5"]
    rows = [(u.format(i=i), own is bad) for own in (bad, good) for u in own for i in range(40)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(i, u.replace("info", "biz"), b) for i, (u, b) in enumerate(rows)], "page_id long, url string, block boolean")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labelled, []).collect()}
    assert got == {i: "block" if b else "allow" for i, (_, b) in enumerate(rows)}


def test_rules_of_long_urls_equal_brute_force(spark):
    """Tokens of the same rows, tokens of blocked rows only, and 60 shared segments."""
    long = [f"s{i}" for i in range(60)]
    rows = [(["a", "b", "c"][: 1 + i % 3] + (["p", "q"] if i % 5 else ["z"]) + (long if i % 4 else []), i % 5 > 0 and i % 7 != 1) for i in range(210)]
    rows += [(["only", "a"], True)] * 30
    data = [(frozenset(t), b) for t, b in rows]
    labelled = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    got = {tuple(r.antecedent): r.confidence for r in urls.mine_rules(labelled).collect()}
    held = lambda x: [b for t, b in data if set(x) <= t]
    names = ["a", "b", "c", "p", "q", "z", "s0", "s59", "only"]
    found = {x: sum(held(x)) / len(held(x)) for k in (1, 2, 3) for x in combinations(sorted(names), k) if sum(held(x)) >= 20}
    found = {x: c for x, c in found.items() if c >= 0.8}
    want = {x: c for x, c in found.items() if not any(set(y) < set(x) and d >= c for y, d in found.items())}
    assert {x: c for x, c in got.items() if set(x) <= set(names) and len(x) < 4} == pytest.approx(want)


def brute_rules(data, least, need, confidence):
    """Token sets of up to three with enough blocked rows and confidence, shorter ones first."""
    blocked = Counter(x for t, b in data if b for k in (1, 2, 3) for x in combinations(sorted(t), k))
    blocked = {x: c for x, c in blocked.items() if c >= (least if len(x) == 1 else need)}
    freq = Counter(x for t, _ in data for k in (1, 2, 3) for x in combinations(sorted(t), k) if x in blocked)
    good = {x: c / freq[x] for x, c in blocked.items() if c / freq[x] >= confidence}
    return {x: c for x, c in good.items() if len(x) == 1 or not any(set(y) < set(x) and d >= c for y, d in good.items())}


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_query_matches_brute_force(spark, scale):
    """Labels, rules, and verdicts without the operator's own ``mined``."""
    rows = pq.read_table(f"/root/testdata/sf{scale}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    seen = spark.createDataFrame([(r["page_id"], r["url"]) for r in rows], "page_id long, url string")
    seen = seen.withColumn("h", urls.url_host(seen.url)).withColumn("p", urls.url_path(seen.url))
    tokens = {r.page_id: set(r.t) for r in seen.select("page_id", urls.url_tokens(seen.url, seen.h, seen.p).alias("t")).collect()}
    known = {r["page_id"]: bool(set(re.split("[.-]", brute(r["url"])[0])) & set(urls.UNWANTED)) or (brute(r["url"])[2] is not None and brute(r["url"])[3] == "block") for r in rows}
    need = max(20, -(-len(rows) * 5 // 1000))
    rules = brute_rules([(tokens[k], b) for k, b in known.items()], 20, need, 0.8)
    found = {r.page_id: r for r in op4_url_filters(spark, f"/root/testdata/sf{scale}").collect()}
    assert len(found) == len(rows) and rules
    for r in rows:
        host, path, rule, verdict = brute(r["url"])
        mined = any(set(x) <= tokens[r["page_id"]] for x in rules)
        got = found[r["page_id"]]
        assert (got.host, got.path, got.rule, got.mined) == (host, path, rule, mined)
        assert got.verdict == (verdict if rule else "block" if mined else "allow")
    assert any(g.mined for g in found.values()) and (scale == "0.01" or any(g.mined and g.rule is None for g in found.values()))


def test_many_listed_rules_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "x")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "url string, block boolean")
    more = URL_RULES + [("block", f"h{i}.info", f"/{i}") for i in range(2100)]
    assert len(more) > urls.LITERAL_RULES
    got = urls.filter_urls(pages, none, more).collect()
    assert len(got) == len(URLS) + 1 and all((r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id]) for r in got)


def test_a_rare_pair_is_a_rule_among_many_rows(spark):
    """A hundred blocked rows of 30,000: a third of a percent, and each token is half allowed."""
    rows = spark.range(30_000).selectExpr("CASE id % 300 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('a') WHEN 2 THEN array('b') ELSE array('c') END AS tokens", "id % 300 = 0 AS block")
    assert [(r.antecedent, r.confidence, round(r.support * 30_000)) for r in urls.mine_rules(rows).collect()] == [(["a", "b"], 1.0, 100)]
