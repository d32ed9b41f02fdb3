"""From raw sources to training and validation sets: samples, an exact split, frequencies, prepared rows, and their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions.lattice import Phrases
from ..functions.profile import LATIN, Profile
from ..functions.text import normalise
from ..operators import augment, sample, segment
from . import config as configuration


#: Copies of one text that are numbered by one row.
BLOCK = 10_000


def texts_of(spark: SparkSession, source: dict, number: int) -> DataFrame:
    """key, text of one source {kind, path, columns}: lines of JSON lists, lines of text, or text columns of Parquet."""
    kind, path = source["kind"], source["path"]
    if kind == "parquet":
        rows = sources.load(spark, path, "parquet").withColumn("_row", F.lit(0))
        return keyed(sources.unpivot_texts(rows, source["columns"], "_row"), f"{number}", F.col("column"))
    readers = {"jsonl": sources.jsonl, "text": sources.text_lines}
    if kind not in readers:
        raise ValueError(f"unknown source: {kind}")
    return keyed(readers[kind](spark, path).select(F.explode("sentences").alias("text")), f"{number}")


def keyed(texts: DataFrame, number: str, *part: Column) -> DataFrame:
    """key, text: the source's number, the text's hash and which of its copies it is, so that a key doesn't depend on how files are split.

    Copies are counted, then numbered in blocks that Spark deals out again: a text that is a third of all rows is no hot spot.
    """
    counted = texts.select("text", F.concat_ws("-", F.lit(number), *part, F.md5("text")).alias("of")).groupBy("text", "of").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.select("text", "of", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("first")).hint("rebalance")
    copies = blocks.select("text", "of", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + BLOCK, F.col("n")) - 1)).alias("copy"))
    return copies.select(F.concat_ws("-", "of", "copy").alias("key"), "text")


def run(spark: SparkSession, config: dict, reader: Callable[[Column], Column], profile: Profile = LATIN, allow: str = "", words: Phrases | None = None) -> dict[str, DataFrame]:
    """train and validation samples, frequency, totals, prepared validation rows; written below ``output`` if it is set.

    ``reader`` gives the readings of the characters of a word, ``words`` is the lexicon by which target runs are cut into words first.
    Frequencies are those of all samples, before the split.  The same texts in other files, or files split in
    another way, make the same rows.
    """
    c = configuration.settled(config)
    texts = sources.union([texts_of(spark, s, i) for i, s in enumerate(c["sources"])])
    texts = texts.select("key", normalise(F.col("text"), profile, allow).alias("text"))
    cut = segment.Cut(c["seed"], **c["windows"])
    made = segment.text_samples(texts, "key", reader, cut, c["segmentation"]["least_ratio"], profile, c["segmentation"]["mode"], words)
    made = made.withColumn("id", F.concat_ws(":", "key", "start")).drop("key", "start")
    if c["output"]:
        made.write.mode("errorifexists").parquet(f"{c['output']}/samples")
        made = spark.read.parquet(f"{c['output']}/samples")
    train, held = sample.split(made, "id", 1 - c["split"]["train"], c["seed"])
    freq = augment.sample_frequency(made)
    chars = F.aggregate(F.transform("text_list", F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    totals = made.agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))
    v = c["validation"]
    prepared = augment.prepared(held, "id", v["no_context"], v["forward"], c["seed"], augment.as_map(freq), v["confusion"])
    out = {"train": train, "validation": held, "frequency": freq, "prepared": prepared, "totals": totals}
    if c["output"]:
        from ..sources.mds import write_mds

        rows = train.select("id", *[F.to_json(x).alias(x) for x in ("text_list", "labels", "pinyin_list")])
        write_mds(rows.repartitionByRange(c["split"]["shards"], "id"), f"{c['output']}/train")
        sources.write_frequency(freq, f"{c['output']}/frequency.json")
        sources.log_metrics(totals, f"{c['output']}/totals", 0)
        sources.write_arrow(held, f"{c['output']}/validation_original")
        sources.write_arrow(prepared.select("id", "prefix", "suffix", "readings"), f"{c['output']}/validation")
    return out
