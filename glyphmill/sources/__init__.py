"""Scans and sinks.  Paths are whatever Spark's readers open; nothing here opens data files itself."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc", "text")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are JSON lists of strings, as ``sentences``; blank and malformed lines and other JSON are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return sentences_of(lines.select(F.btrim("value", F.lit(" \t\r\n")).alias("value")))


def sentences_of(lines: DataFrame) -> DataFrame:
    return lines.where("value like '[%'").select(F.from_json("value", "array<string>").alias("sentences")).where("sentences is not null")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line without the white space around it is one sentence; blank lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.btrim("value", F.lit(" \t\r\n")).alias("value")).where("value <> ''").select(F.array("value").alias("sentences"))


def unpivot_texts(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row for each text column that is there and not empty: key, column, text."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of {columns} in {df.columns}")
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in present])
    return df.select(key, F.explode(items).alias("x")).select(key, "x.column", "x.text").where("text is not null and text <> ''")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as one string."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark can write; never over what is there."""
    fs, at = _file(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def json_object(spark: SparkSession, path: str, label: str = "file") -> dict:
    """The JSON object of a file."""
    try:
        value = json.loads(read_text(spark, path))
    except (ValueError, FileNotFoundError) as e:
        raise ValueError(f"{label} can't be read as JSON: {path}: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"{label} is not a JSON object: {path}")
    return value


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    if not any(c in path for c in "*?[{") and not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.format(kind).load(path)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources."""
    if not frames:
        raise ValueError("no source")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def vocabulary_lines(text: str, strict: bool = False) -> list[str]:
    """Tokens of a vocabulary file in order: empty lines skipped, a line of backslash and n is a line end.

    Strict: neither empty nor with duplicates.
    """
    tokens = ["\n" if x == "\\n" else x for x in (line.rstrip("\r") for line in text.split("\n")) if x]
    if strict and (not tokens or len(set(tokens)) < len(tokens)):
        raise ValueError("empty vocabulary" if not tokens else "duplicate tokens")
    return tokens


def read_vocabulary(spark: SparkSession, path: str, strict: bool = False) -> list[str]:
    return vocabulary_lines(read_text(spark, path), strict)


def vocabulary_table(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """token, id of a vocabulary file; of duplicates the first counts."""
    return spark.createDataFrame(list(map(tuple, enumerate(dict.fromkeys(read_vocabulary(spark, path, strict))))), "id int, token string").select("token", "id")


def frequency_rows(df: DataFrame, column: str) -> DataFrame:
    """ch, reading, prob of JSON objects {ch: {reading: prob}}."""
    parsed = df.select(F.from_json(column, "map<string,map<string,double>>").alias("m"))
    return parsed.select(F.explode("m").alias("ch", "r")).select("ch", F.explode("r").alias("reading", "prob"))


def frequency_json(freq: DataFrame) -> DataFrame:
    """One row with the JSON object of a frequency table (as many entries as characters have readings)."""
    inner = freq.groupBy("ch").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reading", "prob")))).alias("r"))
    by_ch = F.array_sort(F.collect_list(F.struct("ch", "r")), lambda a, b: F.when(a["ch"] < b["ch"], -1).when(a["ch"] > b["ch"], 1).otherwise(0))
    return inner.agg(F.to_json(F.map_from_entries(by_ch)).alias("json"))


def write_frequency(freq: DataFrame, path: str) -> None:
    """The table as one JSON file; it has an entry for each character and reading, whatever the corpus."""
    out: dict[str, dict[str, float]] = {}
    for r in freq.orderBy("ch", "reading").toLocalIterator():
        out.setdefault(r.ch, {})[r.reading] = r.prob
    write_text(freq.sparkSession, path, json.dumps(out, ensure_ascii=False))


def write_arrow(df: DataFrame, path: str, files: int = 1) -> None:
    """Rows in so many files, read again by ``load``."""
    df.repartition(files).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_shards(df: DataFrame, path: str, shards: int, key: str, rows: int = 1_000_000) -> None:
    """Exactly contiguous shards by a numeric key, each a folder ``shard=i``, no file above ``rows`` rows; never over what is there."""
    from ..operators.sample import contiguous_shards

    parts = contiguous_shards(df, shards, key)
    parts.repartition(shards, "shard").sortWithinPartitions("shard", key).write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy("shard").parquet(path)


def log_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """One more step of a log of metrics."""
    metrics.withColumn("step", F.lit(step)).write.mode("append").json(path)


def write_package(spark: SparkSession, path: str, files: dict[str, str]) -> None:
    """Small text files as a folder that appears as a whole or not at all; never over what is there."""
    fs, at = _file(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part"
    fs.delete(_file(spark, part)[1], True)
    for name, text in files.items():
        write_text(spark, f"{part}/{name}", text)
    if not fs.rename(_file(spark, part)[1], at):
        raise OSError(f"can't rename {part}")


def merged_manifests(models: DataFrame, ops: str, keys: str) -> DataFrame:
    """One row: all ops sorted, all keys in the order of their first occurrence by ``position``."""
    rows = models.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ops)))).alias(ops), F.sort_array(F.collect_list(F.struct("position", keys))).alias("k"))
    return rows.select(ops, F.array_distinct(F.flatten(F.transform("k", lambda x: x[keys]))).alias(keys))
