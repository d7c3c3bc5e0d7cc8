"""``python -m emberline VERB``: run registered queries; keep labels and timings; fit a model."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="emberline")
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *places: str) -> argparse.ArgumentParser:
        own = verbs.add_parser(name, help=about)
        for place in places:
            own.add_argument(place)
        return own

    verb("list", "names of the registered queries")
    run = verb("run", "one query over a folder of Parquet tables", "query", "folder")
    shown = run.add_mutually_exclusive_group()
    shown.add_argument("--explain", action="store_true", help="show its plan only")
    shown.add_argument("--output", help="write its rows as Parquet")
    verb("init", "begin a store of labels and timings", "store")
    verb("labels", "positives of a store with their timings", "store")
    add = verb("add", "label a reviewed snapshot (path, file); those not named are negative", "store", "snapshot")
    add.add_argument("--positive", action="append", default=[], metavar="NAME")
    timings = verb("timings", "intervals of a positive among media (path, file, digest, duration_s)", "store", "media", "name")
    timings.add_argument("--interval", action="append", required=True, metavar="START:END")
    timings.add_argument("--error", type=float)
    train = verb("train", "fit a model to a table of label, weight and features", "table", "model")
    train.add_argument("--family", default="logistic")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    asked = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from emberline.operators import models
    from emberline.plans import labelling
    from emberline.queries import QUERIES

    if asked.verb == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if asked.verb == "run" and asked.query not in QUERIES:
        raise SystemExit(f"no query {asked.query}")
    if asked.verb == "train" and asked.family not in models.FAMILIES:
        raise SystemExit(f"no family {asked.family}; there are {', '.join(sorted(models.FAMILIES))}")
    spark = SparkSession.builder.getOrCreate()
    try:
        if asked.verb == "run":
            out = QUERIES[asked.query](spark, asked.folder)
            if asked.output:
                out.write.mode("errorifexists").parquet(asked.output)
            else:
                out.explain("formatted") if asked.explain else out.show(50, truncate=False)
        elif asked.verb == "init":
            labelling.initialise(spark, asked.store)
        elif asked.verb == "labels":
            labelling.overview(spark, asked.store).show(1000, truncate=False)
        elif asked.verb == "add":
            labelling.add(asked.store, spark.read.parquet(asked.snapshot), asked.positive)
        elif asked.verb == "timings":
            labelling.time(asked.store, spark.read.parquet(asked.media), asked.name, asked.interval, asked.error)
        else:
            table = spark.read.parquet(asked.table)
            models.fit(table, [c for c in table.columns if c not in ("label", "weight", "clip")], asked.family).write().save(asked.model)
    except (ValueError, FileExistsError, FileNotFoundError) as fault:
        raise SystemExit(str(fault)) from fault


if __name__ == "__main__":
    main()
