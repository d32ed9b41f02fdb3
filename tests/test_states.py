"""Metric states, streams that stop and go on, stores that are read by epochs, attention by tiles, experts, beams that cannot be."""

import json
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import beam, metrics, ragged
from glyphmill.sources import mds
from glyphmill.streaming.metrics import latest_metrics, latest_state, stream_states

KIND = "id long, logits array<array<double>>, targets array<int>"


def sentences(n, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = i % 4
        rows.append((i, r.normal(size=(m, 7)).round(2).tolist(), r.integers(0, 7, m).tolist()))
    return rows


def expected(rows, bins, k):
    tokens = [(x, t) for _, xs, ts in rows for x, t in zip(xs, ts)]
    rank = [sum(v > x[t] or (v == x[t] and i < t) for i, v in enumerate(x)) for x, t in tokens]
    conf = [sum(sorted((math.exp(v) / sum(map(math.exp, x)) for v in x), reverse=True)[:k]) for x, _ in tokens]
    at = iter(rank)
    whole = [all([next(at) == 0 for _ in ts]) for _, _, ts in rows]
    order = np.argsort(conf, kind="stable")
    ece = sum(abs(sum(rank[i] < k for i in b) - sum(conf[i] for i in b)) for b in np.array_split(order, bins)) / len(tokens)
    return len(tokens), *[sum(r < n for r in rank) / len(rank) for n in (1, 3, 5)], len(rows), sum(whole) / len(rows), ece


def test_merged_states_are_that_of_the_whole(spark):
    rows = sentences(400)
    df = spark.createDataFrame(rows, KIND)
    one = metrics.state(df, "logits", "targets", bins=6, top_k=2)
    parts = metrics.state(df.withColumn("rank", F.col("id") % 3), "logits", "targets", ["rank"], bins=6, top_k=2)
    merged = metrics.merge(parts.drop("rank"))
    columns = sorted(one.columns)
    assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, merged.select(columns).collect()))
    assert tuple(metrics.finalised(merged).first()) == pytest.approx(expected(rows, 6, 2), abs=1e-4)
    by = {r["rank"]: r for r in metrics.finalised(metrics.merge(parts, ["rank"]), ["rank"]).collect()}
    for k in range(3):
        assert tuple(by[k])[1:] == pytest.approx(expected([r for r in rows if r[0] % 3 == k], 6, 2), abs=1e-4)
    other = metrics.state(df, "logits", "targets", bins=6, top_k=3)
    with pytest.raises(Exception, match="differing top_k"):
        metrics.merge(one.unionByName(other)).collect()


def test_states_of_nothing(spark):
    df = spark.createDataFrame([(0, [], []), (1, None, None)], KIND)
    r = metrics.finalised(metrics.merge(metrics.state(df, "logits", "targets"))).first()
    assert (r.tokens, r.acc, r.ece, r.sentences, r.s_acc) == (0, 0.0, 0.0, 2, 1.0)
    # all confidences alike: one range, cut by every bin
    df = spark.createDataFrame([(i, [[0.0] * 5], [i % 5]) for i in range(40)], KIND)
    r = metrics.finalised(metrics.state(df, "logits", "targets", bins=3, top_k=5)).first()
    assert r.tokens == 40 and r.top5_acc == 1 and r.ece == pytest.approx(0, abs=1e-6)


def test_a_stopped_stream_goes_on(spark, tmp_path):
    rows = sentences(300, 5)
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write = lambda part: spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
    run = lambda: stream_states(spark, source, KIND, sink, checkpoint, bins=4, top_k=3).awaitTermination(120)
    write(rows[:100])
    run()
    first = latest_metrics(spark, sink).first()
    assert first.sentences == 100
    write(rows[100:180])
    write(rows[180:])
    run()
    run()  # nothing new
    whole = metrics.state(spark.createDataFrame(rows, KIND), "logits", "targets", bins=4, top_k=3)
    columns = sorted(whole.columns)
    assert sorted(map(tuple, latest_state(spark, sink).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert tuple(latest_metrics(spark, sink).first()) == pytest.approx(expected(rows, 4, 3), abs=1e-4)


def store(spark, path, n=230, limit=400):
    df = spark.createDataFrame([(f"{i:04}", "é" * (i % 9)) for i in range(n)], "id string, text string").repartitionByRange(3, "id")
    return df, mds.write_mds(df, path, limit=limit)


def test_epochs_of_a_store(spark, tmp_path):
    path = str(tmp_path / "m")
    df, shards = store(spark, path)
    assert shards > 5
    plain = mds.read_epoch(spark, path, tasks=4).orderBy("position").collect()
    assert [r.id for r in plain] == [f"{i:04}" for i in range(230)] and [r.sample for r in plain] == list(range(230))
    order = {e: [r.id for r in mds.read_epoch(spark, path, epoch=e, seed=3, block=8).orderBy("position").collect()] for e in (0, 1)}
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1]) == [f"{i:04}" for i in range(230)]
    # the number of tasks changes nothing, and reading goes on from any sample
    for skip in (0, 1, 8, 13, 229, 230):
        rest = mds.read_epoch(spark, path, epoch=1, seed=3, block=8, skip=skip, tasks=2).orderBy("position").collect()
        assert [r.id for r in rest] == order[1][skip:] and [r.position for r in rest] == list(range(skip, 230))
    # blocks stay together
    near = sum(abs(int(a) - int(b)) < 8 for a, b in zip(order[0], order[0][1:]))
    assert near > 150


def test_a_failed_write_leaves_no_shard(spark, tmp_path):
    path = str(tmp_path / "m")
    bad = spark.range(200).repartitionByRange(4, "id").select(F.when(F.col("id") == 190, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        mds.write_mds(bad, path, limit=50)
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
    store(spark, path)
    with pytest.raises(FileExistsError):
        store(spark, path)
    mds.register(spark)
    spark.createDataFrame([("x", "y")], "id string, text string").write.format("mds").mode("overwrite").option("path", mds.qualified(spark, path)).save()
    assert [r.id for r in mds.read_mds(spark, path).collect()] == ["x"] and sorted(os.listdir(path)) == ["index.json", "shard.00000.mds.zstd"]
    assert json.loads((tmp_path / "m/index.json").read_text())["shards"][0]["samples"] == 1
    assert not [d for d in os.listdir(tmp_path) if ".part-" in d]


def dense(x, y, z, causal):
    score = x @ y.T / math.sqrt(x.shape[1])
    if causal:
        score[np.triu_indices(len(x), 1)] = -np.inf
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True) @ z


@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("queries, keys", [(4, 3), (3, 5), (64, 64)])
def test_attention_by_tiles(spark, causal, queries, keys):
    r = np.random.default_rng(1)
    x = {k: r.normal(size=(3, n, 6)) * 3 for k, n in (("a", 17), ("b", 1), ("c", 9))}
    rows = [(k, i, *(v[j][i].tolist() for j in range(3))) for k, v in x.items() for i in range(v.shape[1])]
    df = spark.createDataFrame(rows, "s string, i long, q array<double>, k array<double>, v array<double>").repartition(3)
    got = {(o.s, o.i): o.out for o in ragged.attend(df, "s", "i", "q", "k", "v", causal, queries, keys).collect()}
    assert len(got) == 27
    for k, v in x.items():
        want = dense(*v, causal)
        assert all(np.allclose(got[k, i], want[i]) for i in range(len(want)))


def test_attention_of_a_long_sequence(spark):
    n = 100_000
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("s"), F.col("id").alias("i"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    out = ragged.attend(df, "s", "i", "x", "x", "x").where(f"i IN (0, 4095, 4096, {n - 1})").collect()
    x = np.stack([np.sin(np.arange(n)), np.cos(np.arange(n))], axis=1)
    assert len(out) == 4
    for r in out:
        w = np.exp(x[: r.i + 1] @ x[r.i] / math.sqrt(2))
        assert np.allclose(r.out, w @ x[: r.i + 1] / w.sum(), atol=1e-9)


def test_experts_are_added_up(spark):
    r = np.random.default_rng(2)
    n, dim, hidden = 50, 5, 3
    x, score = r.normal(size=(n, dim)), r.normal(size=(n, 4)).round(3)
    made = lambda: tuple(r.normal(size=s) for s in ((dim, hidden), (dim, hidden), (hidden, dim)))
    weights, common = {e: made() for e in range(4)}, made()
    f = lambda v, w: ((v @ w[1]) / (1 + np.exp(-(v @ w[1]))) * (v @ w[0])) @ w[2]
    want = f(x, common)
    for e in range(4):
        for i in sorted(range(n), key=lambda i: (-score[i, e], i))[: max(1, n * 2 // 4)]:
            want[i] += f(x[i], weights[e]) / (1 + math.exp(-score[i, e]))
    df = spark.createDataFrame([(i, x[i].tolist(), score[i].tolist()) for i in range(n)], "id long, x array<double>, s array<double>").repartition(4)
    got = {o.id: o.out for o in metrics.mixture(df, "id", "x", "s", weights, common).collect()}
    assert len(got) == n and all(np.allclose(got[i], want[i]) for i in range(n))


def test_beams_that_cannot_be_are_kept(spark):
    scores = spark.createDataFrame([(-1, 6, -0.5), (6, 10, -0.2)], "prev int, id int, score double")
    allowed = spark.createDataFrame([("a", 0, 6), ("a", 1, 10)], "key string, position int, id int")
    steps = beam.step_scores(scores, allowed)
    got = beam.beam_search(steps, 2, 3, classes=20).orderBy("rank").collect()
    assert len(got) == 3 and [math.isfinite(r.score) for r in got] == [True, False, False] and list(got[0].ids) == [6, 10] and got[0].score == pytest.approx(0)
    assert list(got[1].ids) == [6, 0] and list(got[2].ids) == [6, 1]
    assert len(beam.beam_search(steps, 2, 3).collect()) == 1
    with pytest.raises(ValueError):
        beam.beam_search(steps, 2, 21, classes=20)


def test_arrow_of_the_store_is_strings(spark, tmp_path):
    _, _ = store(spark, str(tmp_path / "m"), 3)
    assert {f.dataType.simpleString() for f in mds.read_mds(spark, str(tmp_path / "m")).schema.fields} == {"string"}
    assert pa.string() == pa.utf8()
