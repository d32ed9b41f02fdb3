"""``python -m glyphmill preprocess CONFIG.json``, ``subset SOURCE KIND KEY SIZE OUTPUT`` or ``query NAME SF_DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import text
from .operators import sample
from .plans import catalog, preprocess
from .sources import json_object, load, write_shards


def amount(size: str) -> int | float:
    """A whole number of rows, or with a point a share of them."""
    return float(size) if "." in size else int(size)


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    tasks = parser.add_subparsers(dest="task", required=True)
    tasks.add_parser("preprocess").add_argument("config")
    one = tasks.add_parser("query")
    one.add_argument("name", choices=sorted(catalog.QUERIES))
    one.add_argument("sf_dir")
    part = tasks.add_parser("subset")
    for name in ("source", "kind", "key", "size", "output"):
        part.add_argument(name)
    part.add_argument("--shards", type=int, default=1)
    part.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    if args.task == "subset":
        rows = load(spark, args.source, args.kind)
        kept = sample.subset(rows, args.key, amount(args.size), args.seed)
        write_shards(kept, args.output, args.shards, args.key)
        print("source", rows.count(), "subset", load(spark, args.output, "parquet").count())
        return
    if args.task == "query":
        catalog.QUERIES[args.name](spark, args.sf_dir).show(20, truncate=False)
        return
    out = preprocess.run(spark, json_object(spark, args.config, "configuration"), text.letter_readings)
    for name, df in out.items():
        print(name, df.count())


if __name__ == "__main__":
    main()
