"""The registered queries of the training-data operators, one ``opN_`` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests, bpe_round_trip
from .common import cut, read_table
from .fingerprints import linked_fingerprints
from .html import extract_main_text
from .mixing import mix_sources
from .mixing_sql import MIXING_SQL
from .neardup import near_duplicates
from .neardup_sql import NEAR_SQL
from .packing import pack_sequences
from .quality import quality_rules
from .rolling import ROLLING_SQL, rolling_users
from .secrets import secret_scan
from .substrings import remove_repeats
from .tokens import token_counts
from .urls import filter_urls, known_labels
from .variants import spelling_variants


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    return mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and digests of secrets in all documents; a repository is a source's documents of one language."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    docs = docs.withColumn("repo", F.concat_ws("/", "source", "lang"))
    return secret_scan(docs, repo="repo", keep=["doc_id"]).drop("secrets")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"))


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs, by listed rules, then by rules mined from labels known of hosts and listed rules."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return filter_urls(pages, known_labels(pages, URL_RULES), URL_RULES)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on shingles of four words."""
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), width=4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return pack_sequences(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with groups of near ones."""
    return linked_fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of all documents as repeated bytes, and the passages they share."""
    return remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed", "passages")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of the quality rules for all documents."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules(docs, keep=["doc_id"])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with their near words and forms."""
    return spelling_variants(read_table(spark, sf_dir, "documents", "doc_id", "text"))


#: Names and minutes of the trailing windows; users with 5 clicks or more of the longest.
WINDOWS, HOT = {"users_short": 10, "users_middle": 60, "users_long": 720}, ("hot_users", 5, 720)


def op12_rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of trailing windows at every minute with a click, by kind."""
    return rolling_users(read_table(spark, sf_dir, "clicks", "click_id", "ts", "client_id", "kind"), WINDOWS, HOT)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts that they decode to."""
    return bpe_digests(bpe_round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"]), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_minhash": op5_minhash,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_arrays": op9_suffix_arrays,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_rolling_users": op12_rolling_users,
    "op13_bpe_codec": op13_bpe_codec,
}

#: Whole-table SQL, where SQL can express a query.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": MIXING_SQL,
    "op5_minhash": NEAR_SQL,
    "op12_rolling_users": ROLLING_SQL,
}
