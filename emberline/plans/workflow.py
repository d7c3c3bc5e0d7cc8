"""Declarative plans: named steps over DataFrames, run identity, resume by key."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.stores import fingerprint


@dataclass(frozen=True)
class Step:
    """A step reads named tables and gives one."""

    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    groups: frozenset[str] = field(default_factory=frozenset)


def choose(steps: Sequence[Step], group: str) -> list[Step]:
    """The steps of one experiment group; those without groups belong to all."""
    return [s for s in steps if not s.groups or group == "all" or group in s.groups]


def identity(steps: Sequence[Step], inputs: dict[str, str]) -> str:
    return fingerprint({"steps": [[s.name, list(s.reads)] for s in steps], "inputs": inputs})[:20]


def run(spark: SparkSession, steps: Sequence[Step], tables: dict[str, DataFrame], folder: str | None = None, dry: bool = False) -> dict[str, DataFrame]:
    """Each step over the tables before it, written to ``folder`` if given, which
    must not hold it yet.  ``dry`` explains the plans and writes nothing."""
    tables = dict(tables)
    for step in steps:
        if missing := [r for r in step.reads if r not in tables]:
            raise KeyError(f"{step.name} reads {missing}, which no step before it makes")
        out = step.make(*(tables[r] for r in step.reads))
        if dry:
            out.explain("formatted")
        elif folder:
            out.write.mode("errorifexists").parquet(f"{folder}/{step.name}")
            out = spark.read.parquet(f"{folder}/{step.name}")
        tables[step.name] = out
    return tables


class CompanionError(RuntimeError):
    """The first failure of companions; ``name`` says whose."""

    def __init__(self, name: str, cause: BaseException):
        super().__init__(f"{name} failed: {cause}")
        self.name = name


def companions(spark: SparkSession, work: dict[str, Callable[[SparkSession], object]]) -> dict[str, object]:
    """The results of all pieces of work, which run at the same time.

    Each runs under a job tag of its own.  When one fails, the jobs of the others
    and the streams that they started are stopped, and its failure is raised once
    all have ended.  A piece that starts a job after that is stopped as well.
    """
    context, mark = spark.sparkContext, uuid.uuid4().hex
    before, failed = {q.id for q in spark.streams.active}, threading.Event()
    first: list[tuple[str, BaseException]] = []

    def one(name: str, make: Callable[[SparkSession], object]) -> object:
        context.addJobTag(f"{mark}-{name}")
        context.setInterruptOnCancel(True)  # tasks that run are stopped, not only those to come
        try:
            return make(spark)
        except BaseException as error:
            if not failed.is_set():
                first.append((name, error))
                failed.set()
            raise
        finally:
            context.removeJobTag(f"{mark}-{name}")
            context.setInterruptOnCancel(False)

    with ThreadPoolExecutor(len(work) or 1) as pool:
        # each in a thread of its own on the other side too, so that tags stay apart
        futures = {name: pool.submit(inheritable_thread_target(spark)(one), name, make) for name, make in work.items()}
        while not all(f.done() for f in futures.values()):
            wait(futures.values(), timeout=0.2)
            if failed.is_set():
                for name, future in futures.items():
                    if not future.done():
                        context.cancelJobsWithTag(f"{mark}-{name}")
                for query in spark.streams.active:
                    if query.id not in before:
                        query.stop()
    if first:
        raise CompanionError(*first[0]) from first[0][1]
    return {name: f.result() for name, f in futures.items()}


def unfinished(wanted: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """What is still to be made, by content key."""
    return wanted.join(done.select(key), key, "left_anti")


def report(summary: DataFrame, title: str) -> str:
    """A small summary table as Markdown."""
    rows = summary.limit(1000).collect()
    head = summary.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def merged_summary(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result files of several runs with their file's name."""
    return spark.read.json(list(paths)).withColumn("run", F.input_file_name())
