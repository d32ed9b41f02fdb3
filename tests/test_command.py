"""The command line's subset task."""

import pytest
from pyspark.sql import functions as F

from glyphmill import __main__ as command


def test_subset(spark, tmp_path, capsys):
    spark.range(101).select("id", F.col("id").cast("string").alias("text")).write.parquet(str(tmp_path / "in"))
    for size, n in (("0.5", 50), ("7", 7), ("1000", 101), ("0", 0)):
        out = str(tmp_path / f"out{size}")
        if not n:
            assert command.amount(size) == 0
            continue
        command.main(["subset", str(tmp_path / "in"), "parquet", "id", size, out, "--shards", "3", "--seed", "5"])
        rows = spark.read.parquet(out)
        assert rows.count() == n and rows.select("id").distinct().count() == n and rows.select("shard").distinct().count() == 3
        sizes = sorted(r["count"] for r in rows.groupBy("shard").count().collect())
        assert sizes[-1] - sizes[0] <= 1
        assert f"source 101 subset {n}" in capsys.readouterr().out
    with pytest.raises(ValueError):
        command.main(["subset", str(tmp_path / "in"), "other", "id", "3", str(tmp_path / "x")])
    with pytest.raises(FileNotFoundError):
        command.main(["subset", str(tmp_path / "none"), "parquet", "id", "3", str(tmp_path / "x")])
