"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes the documents that the one before it kept, read again from
Parquet, and all but the last return rows with the columns of ``documents``.
Null and empty texts, ties, repeated rows, empty tables and extra columns are
handled as each operator says; rows of one key are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import Folder, cut, read_table
from emberline.llm.mixing import mix_sources
from emberline.llm.neardup import near_duplicates
from emberline.llm.packing import pack_sequences
from emberline.llm.quality import keep_good
from emberline.llm.secrets import redact, secret_scan

KEY, PRINT = "_pipeline_key", "_pipeline_print"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on shingles of five words."""
    groups = cut(near_duplicates(docs, width=5).where("kept").groupBy(F.col("doc_id").alias(KEY)).agg(F.count("*").alias("rows")))
    out = docs.join(groups.select(KEY), F.col("doc_id").eqNullSafe(F.col(KEY)), "left_semi")
    # rows that repeat both key and text are one document
    return out.dropDuplicates(["doc_id", "text"]) if groups.where("rows > 1").limit(1).count() else out


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced by their kind."""
    named = docs.select(F.col("doc_id").alias(KEY), F.xxhash64("text").alias(PRINT), "text", "source", F.concat_ws("/", "source", "lang").alias("repo"))
    found = secret_scan(named, repo="repo", keep=[KEY, PRINT]).where("n_live > 0").select(KEY, PRINT, F.filter("secrets", lambda s: s["live"]).alias("_pipeline_live")).dropDuplicates([KEY, PRINT])
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(KEY)) & (F.xxhash64("text") == F.col(PRINT)), "left")
    hidden = redact(joined, "text", "_pipeline_live")
    return hidden.withColumn("n_chars", F.when(F.col("_pipeline_live").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    named = docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias(KEY), "text", "source")
    taken = mix_sources(named, key=KEY).groupBy(KEY).agg(F.sum("copies").alias("_pipeline_copies"), F.count("*").alias("_pipeline_rows"))
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    # rows that repeat share their copies
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("doc_id"))
    copies = F.floor(F.col("_pipeline_copies") / F.col("_pipeline_rows")) + (place <= F.col("_pipeline_copies") % F.col("_pipeline_rows")).cast("long")
    joined = docs.withColumn(KEY, own).join(taken.where("_pipeline_copies > 0"), KEY).withColumn("_pipeline_times", copies).where("_pipeline_times > 0")
    return joined.withColumn("_pipeline_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_pipeline_times")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    return pack_sequences(docs)


STAGES = [("quality", quality), ("near_dups", near_dups), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = Folder(spark)
            docs = folder.stored(docs)
            if before is not None:
                before.remove()
            before = folder
    return docs
