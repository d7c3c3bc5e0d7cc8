"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds credential spans.  Each candidate's hash is then
counted by distinct repository and distinct owner over the whole corpus: a
value that many owners hold, or many repositories, is a widely copied example,
one that only its owner's documents hold in few repositories, and that looks
random, is taken for live.  Base spans
are always reported; of the wider patterns only live-looking ones are added.
Candidates are few against the text, so only they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, text_buffer, unused

# The base patterns.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# The wider patterns.
WIDER = {
    "vendor": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    "login": re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{6,128})@"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"),
}
KINDS = ["assign", "access", "hex", *WIDER]
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MARKS = (b"AKIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xoxa-", b"xoxb-", b"xoxp-", b"xoxr-", b"xoxs-", b"sk_live_", b"glpat-", b"AIza", b"eyJ", b"PRIVATE KEY-----")

SPAN = "struct<start:long,ord:int,kind:string,end:long,hash:string,random:boolean>"
IS_HEX = np.zeros(256, bool)
IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
IS_RUN = np.zeros(256, bool)
IS_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    classes = sum(any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
    return entropy(value) >= 3.0 and classes >= 2 and len(set(value)) >= 8


def find_spans(text: str) -> list[tuple[int, int, str, int, str, bool]]:
    """All candidate spans of one whole text, by start, then kind as listed."""
    found = []
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            value = m[1] if kind == "assign" else m[0]
            if len(value) >= LEAST[kind]:
                found.append((m.start(), m.end(), kind, value))
    taken = bytearray(len(text))
    for start, end, *_ in found:
        taken[start:end] = b"\1" * (end - start)
    for kind, pattern in WIDER.items():
        for m in pattern.finditer(text):
            value = m[m.lastindex or 0]
            # a span that overlaps an earlier kind's adds nothing
            if (kind != "random" or looks_random(value)) and 1 not in taken[m.start() : m.end()]:
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found.append((m.start(), m.end(), kind, value))
    return sorted(((s, KINDS.index(k), k, e, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], looks_random(v)) for s, e, k, v in found), key=lambda x: x[:2])


def _runs(data: np.ndarray, member: np.ndarray, length: int) -> np.ndarray:
    """A position in each stretch of ``length`` or more members, perhaps a few more.

    Such a stretch holds ``length - 7`` members from some multiple of 8 on.
    """
    if len(data) < length:
        return np.zeros(0, np.int64)
    at = np.arange(0, len(data) - (length - 8), 8)
    for k in range(length - 7):
        at = at[member[data[at + k]]]
    return at


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that can hold a span; no other text does."""
    hits = [_runs(data, IS_HEX, 24), _runs(data, IS_RUN, 32)]
    raw = data.tobytes()
    low = raw.lower()
    for where, marks in ((low, WORDS), (raw, MARKS)):
        for mark in marks:
            at, own = where.find(mark), []
            while at >= 0:
                own.append(at)
                # on to the next text, as one hit is enough
                at = where.find(mark, int(offsets[np.searchsorted(offsets, at, side="right")]))
            hits.append(np.array(own, np.int64))
    at, own = raw.find(b"://"), []
    while at >= 0:
        if b"@" in raw[at : at + 800]:
            own.append(at)
        at = raw.find(b"://", at + 3)
    hits.append(np.array(own, np.int64))
    return np.unique(np.searchsorted(offsets, np.concatenate(hits), side="right") - 1)


def scan(df: DataFrame, text: str, keep: list[str], to: str) -> DataFrame:
    """``keep`` columns, base figures and ``to``, the candidate spans."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"n_assign long, n_access long, n_hex long, base_sha256 string, `{to}` array<{SPAN}>"])
    nothing = hashlib.sha256(b"").hexdigest()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1)
        data, offsets = text_buffer(texts)
        n = batch.num_rows
        counts, digests, found = np.zeros((3, n), np.int64), [nothing] * n, [[] for _ in range(n)]
        for i in suspects(data, offsets).tolist():
            spans = find_spans(texts[i].as_py())
            base = [x for x in spans if x[1] < 3]
            for x in base:
                counts[x[1], i] += 1
            digests[i] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e, *_ in base).encode()).hexdigest()
            found[i] = [dict(zip(("start", "ord", "kind", "end", "hash", "random"), x, strict=True)) for x in spans]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *map(pa.array, counts), pa.array(digests), pa.array(found, kind)], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", to])

    name = unused(keep, "_text")
    return map_batches(df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(name)), name, work, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``hash, repos, owners`` from rows of ``hash, repo, owner``.

    Distinct triples first, then counts, each with partial sums before its
    shuffle, so that a value that a third of all rows hold is no burden.
    """
    pairs = found.groupBy("hash", "owner").agg(F.count_distinct(F.coalesce("repo", F.lit(""))).alias("repos"))
    return pairs.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def secret_scan(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "source", keep: list[str] | None = None, most_owners: int = 2, most_repos: int = 3) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with ``n_assign, n_access,
    n_hex, base_sha256, spans, n_live, n_examples, secrets``.

    ``spans`` is ``kind:start:end`` of every base span and of every added one
    (code points, end exclusive), by start, then kind as listed; ``secrets``
    has the same spans with hash, repositories, owners and verdict.  A
    candidate is live if at most ``most_owners`` owners and ``most_repos``
    repositories (of any owner) hold its value and the value looks random.  Null
    texts are empty; empty texts and tables give no
    spans; repeated rows each get their own; null owners count as one owner, null repositories as one of each owner.  Spans
    that start at one place go by kind as listed.
    """
    names = {"n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_examples", "secrets"}
    keep = [c for c in df.columns if c != text and c not in names] if keep is None else keep
    if clash := names & set(keep):
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    mine, at, row, of, found = (unused(df.columns, c) for c in ("_owner", "_repo", "_row", "_of", "_found"))
    own = df.withColumns({mine: F.coalesce(F.col(owner).cast("string"), F.lit("")), at: F.col(repo).cast("string")})
    scanned = cut(scan(own, text, [*keep, mine, at], found)).withColumn(row, F.monotonically_increasing_id())
    each = scanned.where(F.size(found) > 0).select(F.col(row).alias(of), F.col(mine).alias("owner"), F.col(at).alias("repo"), F.explode(found).alias("s"))
    held = ownership(each.select(F.col("s.hash").alias("hash"), "owner", "repo"))
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos) & F.col("s.random")
    judged = each.withColumn("hash", F.col("s.hash")).join(held, "hash").withColumn("live", live).where((F.col("s.ord") < 3) | F.col("live"))
    per_row = judged.groupBy(of).agg(
        F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "hash", "repos", "owners", "live"))).alias("secrets"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_examples"),
    )
    zero = F.lit(0).cast("long")
    return scanned.join(per_row, F.col(row) == F.col(of), "left").select(
        *(F.col(f"`{c}`") for c in keep), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.concat_ws(",", F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_examples", zero).alias("n_examples"), "secrets",
    )


def redact(df: DataFrame, text: str, secrets: str) -> DataFrame:
    """``text`` with each span of ``secrets`` replaced by ``<kind>``, overlapping ones as one."""
    merged = F.aggregate(
        F.col(secrets), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
    )
    # the plain text stays where there is nothing to hide
    return df.withColumn("_m", merged).withColumn(text, F.when(F.size(secrets) > 0, F.concat(F.col("_m.out"), F.substr(F.col(text), (F.col("_m.at") + 1).cast("int")))).otherwise(F.col(text))).drop("_m")
