"""Quality rules from the text alone and from how often its lines are found in other documents of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, save

SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def features(docs: DataFrame) -> DataFrame:
    """Per row the counts of the text, and the hash and number of words of each normalised line."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    normal = F.transform(F.split(F.lower(text), "\n"), lambda x: F.btrim(F.regexp_replace(x, SPACE_CLASS, " "), F.lit(SPACES)))
    df = docs.select("doc_id", "source", F.xxhash64("text").alias("tag"), words(text).alias("w"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.filter(normal, lambda x: x != "").alias("normal"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"))
    df = df.select(
        "doc_id", "source", "tag", "n_symbols",
        F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")).alias("windows"),
        F.transform("normal", lambda x: F.xxhash64(x)).alias("line_hash"),
        F.transform("normal", lambda x: F.size(F.split(x, " "))).alias("line_words"),
    )
    # only texts with a repeated window sort them with their places
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("pairs", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, i, step: F.coalesce(F.get("pairs", i + step)["h"] == x["h"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("pairs", lambda x, i: F.when(i > 0, same(x, i, -1)).otherwise(False) | same(x, i, 1)), lambda x: x["i"]))).drop("pairs")
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def judged(docs: DataFrame, min_docs: int = 20, host_share: float = 0.02, most_docs: int = 100_000, keep_share: float = 0.3, least_words: int = 50) -> DataFrame:
    """The features of each row, the lines in ``common`` that too many documents of its host hold, and the verdict in ``kept``."""
    f = save(features(docs))
    document = F.struct("doc_id", "tag")
    lines = f.select("source", document.alias("document"), F.explode(F.array_distinct("line_hash")).alias("line")).distinct()
    texts = f.select("source", document.alias("document")).distinct().groupBy(F.col("source").alias("_host")).agg(F.count(F.lit(1)).alias("texts"))
    held = lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    limit = F.least(host_share * F.col("texts"), F.lit(most_docs))
    common = held.join(texts, F.col("source").eqNullSafe(F.col("_host"))).where(F.col("n") > limit).select(F.col("source").alias("_source"), F.col("line").alias("_line"))
    found = (
        f.select("doc_id", "source", "tag", F.explode(F.array_distinct("line_hash")).alias("line"))
        .join(common, F.col("source").eqNullSafe(F.col("_source")) & (F.col("line") == F.col("_line")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("tag").alias("_t"))
        .agg(F.collect_set("line").alias("common"))
    )
    f = f.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("tag") == F.col("_t")), "left")
    removed = F.aggregate(F.zip_with("line_hash", "line_words", lambda h, n: F.when(F.array_contains("common", h), n).otherwise(0)), F.lit(0), lambda a, x: a + x)
    n_words, repeat = F.col("n_words").cast("long"), F.col("n_repeat_words")
    f = f.withColumn("n_common_words", F.coalesce(F.when(F.col("common").isNotNull(), removed), F.lit(0)).cast("long"))
    f = f.withColumn("base_failed", (n_words < 50) | (100 * repeat > 50 * n_words))
    left = F.col("n_words") - F.col("n_common_words")
    return f.withColumn("kept", ~F.col("base_failed") & (left >= least_words) & (left >= keep_share * F.col("n_words")))


def line_quality(docs: DataFrame, **limits) -> DataFrame:
    """Judge each document, after the lines that too many documents of its host share are removed.

    A host is a ``source`` (null is one host).  Lines are compared lower-cased, with white space collapsed.
    A line is removed if more than ``min_docs`` documents of the host hold it, and more than ``host_share`` of them or more than ``most_docs``;
    a document is an id with its text, so repeated rows count once and copies under other ids one by one.  A document is rejected if
    it has fewer than 50 words, if more than half of its words lie in repeated 3-word
    windows, or if fewer than ``least_words`` or ``keep_share`` of its words are left.  Returns one row for each row
    of ``docs``, none for an empty table; null and empty text has no words, so it is rejected; very long texts are judged whole; other columns are ignored.
    """
    f = judged(docs, **limits)
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return f.select("doc_id", *longs, "n_repeat_words", "base_failed", "kept", "n_common_words")


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines that too many documents of the host share."""
    gone = judged(docs, **limits).select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("tag").alias("_t"), "kept", "common").dropDuplicates(["_id", "_s", "_t"]).where("kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("host"), F.xxhash64("text").alias("key"))
    joined = keyed.join(gone, F.col("id").eqNullSafe(F.col("_id")) & F.col("host").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_t")))
    line = lambda x: F.xxhash64(F.btrim(F.regexp_replace(F.lower(x), SPACE_CLASS, " "), F.lit(SPACES)))
    rest = F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda x: ~F.array_contains("common", line(x))), "\n")
    out = joined.select("row", F.when(F.col("common").isNull(), F.col("row.text")).otherwise(rest).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
