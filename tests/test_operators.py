"""Facts about single operators, and second definitions where SQL has none."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import sources
from glyphmill.functions import rng, spans, text
from glyphmill.functions.profile import han
from glyphmill.operators import augment, beam, metrics, ragged, sample, segment, vocab
from glyphmill.streaming.segments import segment_rows, stream_label_counts, stream_segments

HAN = han()


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], names).select(column.alias("x")).first().x


def test_brackets_and_spaces(spark):
    rows = spark.createDataFrame([("[笑]哈[]哈[[x]]",), ("中 国 人",), ("中　国",)], "t string")
    got = [r.x for r in rows.select(text.join_spaced(text.strip_brackets(F.col("t")), HAN).alias("x")).collect()]
    assert got == ["哈[]哈]", "中国 人", "中国"]


def test_normalise_order_and_null(spark):
    rows = spark.createDataFrame([("［x］你 好，｡abc",), (None,)], "t string")
    assert [r.x for r in rows.select(text.normalise(F.col("t"), HAN).alias("x")).collect()] == ["你好,。", ""]


def test_two_definitions_of_target(spark):
    p = han(["𠮷", "好"])
    df = spark.createDataFrame([("𠮷好a",)], "t string")
    assert df.select(text.ratio(F.col("t"), p).alias("x")).first().x == pytest.approx(1 / 3)
    assert [s.label for s in df.select(segment.segments(F.col("t"), p).alias("x")).first().x] == [1, 2]


def test_long_run_drop_makes_neighbours(spark):
    df = spark.createDataFrame([("你好" + "A" * 20 + "你好",)], "t string")
    assert [s.text for s in df.select(segment.segments(F.col("t"), HAN).alias("x")).first().x] == ["你好", "你好"]
    assert len(df.select(segment.segments(F.col("t"), HAN, longest_other=20).alias("x")).first().x) == 3
    assert [s.text for s in df.select(segment.segments(F.col("t"), HAN, mode="char").alias("x")).first().x] == ["你", "好", "你", "好"]
    with pytest.raises(ValueError):
        segment.segments(F.col("t"), HAN, mode="x")


@pytest.mark.parametrize(("direction", "sel", "end"), [("backward", 4, 5), ("forward", 3, 5), ("bidirectional", 3, 5)])
def test_span_directions(spark, direction, sel, end):
    df = spark.createDataFrame([([1, 1, 2, 1, 1, 0, 1], 4)], "labels array<int>, k int")
    x = df.select(spans.select_span(F.col("labels"), F.col("k"), direction).alias("x")).first().x
    assert (x.sel, x.end) == (sel, end)


def test_prefix_sums(spark):
    df = spark.createDataFrame([([1, 1, 1, 2, 1], ["今天", "的", "阳光", "BBQ", "呀"])], "l array<int>, t array<string>")
    assert df.select(spans.targets_before(F.col("l"), F.col("t")).alias("x")).first().x == [0, 2, 3, 5, 5, 6]


def jumps(lengths, labels, draw, soft, hard):
    """The windows by prefix sums: the first place that ends one, found from the start alone."""
    n = len(lengths)
    c = [0, *itertools.accumulate(lengths)]
    out, i = [], 0
    while i < n:
        j1 = next((j for j in range(i, n) if c[j] - c[i] >= draw(i)), n)
        if c[j1] - c[i] > hard:
            i = j1
            continue
        following = None
        for j in range(j1, n):
            size = c[j + 1] - c[i]
            if size > max(soft, hard):
                following = (j, None)
                break
            if j > i and labels[j - 1] == 1 and ((size > soft and labels[j] != 1) or (size <= soft and labels[j] == 0)):
                following = (j + (labels[j] == 0), j)
                break
        if following is None:
            out.append((i, n))
            break
        if following[1] is not None:
            out.append((i, following[1]))
        i = following[0]
    return out


def test_windows_two_ways():
    r = random.Random(1)
    for _ in range(3000):
        n = r.randint(0, 25)
        lengths, labels = [r.randint(1, 6) for _ in range(n)], [r.choice([0, 1, 1, 2]) for _ in range(n)]
        draws = [r.randint(1, 12) for _ in range(n)]
        soft, hard = r.randint(5, 20), r.randint(5, 25)
        assert segment.window_bounds(np.array(lengths, dtype=int), np.array(labels, dtype=int), draws.__getitem__, segment.Cut(soft=soft, hard=hard)) == jumps(lengths, labels, draws.__getitem__, soft, hard)


def test_subset_sizes_and_split(spark):
    assert [sample.subset_size(n, 0.5) for n in (3, 5)] == [2, 2]
    assert sample.subset_size(4, 9) == 4 and sample.subset_size(4, -1) == 0
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, test = sample.split(df, "k", 0.0055)
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert len(b) == 6 and not a & b and len(a | b) == 1000
    again = sample.split(df.repartition(7), "k", 0.0055)[1]
    assert {r.k for r in again.collect()} == b


def test_numbering_and_shards(spark):
    df = spark.range(11).select((F.col("id") * 3).alias("k"))
    rows = {r.k: r.row for r in sample.numbered(df, "k").collect()}
    assert rows == {3 * i: i for i in range(11)}
    shards = sample.contiguous_shards(df, 3, "k").groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in shards] == [4, 4, 3]
    assert [sorted(k // 3 for k, i in rows.items() if i % 3 == r) for r in range(3)] == [[0, 3, 6, 9], [1, 4, 7, 10], [2, 5, 8]]


def test_vocabulary(spark):
    assert sources.vocabulary_lines("a\n\n\\n\r\nb") == ["a", "\n", "b"]
    with pytest.raises(ValueError):
        sources.vocabulary_lines("a\nb\na", strict=True)
    df = spark.createDataFrame([("bax",)], "t string")
    assert df.select(vocab.encode(F.col("t"), "ab").alias("x")).first().x == [1, 0]
    assert df.select(vocab.encode_aligned(F.col("t"), "ab").alias("x")).first().x == [1, 0, -100]
    assert df.select(vocab.decode(F.array(F.lit(1), F.lit(7), F.lit(0)), "ab").alias("x")).first().x == "ba"
    words = spark.createDataFrame([("zhen",), ("",), ("b",)], "t string")
    assert [r.x for r in words.select(vocab.nearest(F.col("t"), ["b", "c", "zheng", "shen"]).alias("x")).collect()] == [2, 0, 0]


def test_shorthand_and_possibilities(spark):
    rows = spark.createDataFrame([("zhang",), ("ang",), ("ba",), ("",)], "s string")
    assert [r.x for r in rows.select(text.shorthands(F.col("s")).alias("x")).collect()] == [["zh", "z"], ["a"], ["b"], []]
    lexicon = spark.createDataFrame([("长", "zhang"), ("长", "chang")], "ch string, reading string")
    tokens = spark.createDataFrame([("z", 0), ("c", 1), ("zhang", 2)], "token string, id int")
    assert sorted(r.id for r in vocab.possibilities(lexicon, tokens).collect()) == [0, 1, 2]


def test_frequency(spark):
    rows = spark.createDataFrame([("长", ["zhang"]), ("长", ["chang"]), ("江", [""])], "w string, r array<string>")
    got = {(r.ch, r.reading): r.prob for r in augment.frequency(rows, "w", "r").collect()}
    assert got == {("长", "zhang"): 0.5, ("长", "chang"): 0.5}
    drawn = augment.cumulative(augment.frequency(rows, "w", "r")).select(augment.sampled(F.col("readings"), F.lit(0.49)).alias("a"), augment.sampled(F.col("readings"), F.lit(0.5)).alias("b")).first()
    assert (drawn.a, drawn.b) == ("chang", "zhang")


def test_uniform_is_uniform(spark):
    u = [r.u for r in spark.range(4000).select(rng.uniform(0, "x", "id").alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02
    k = {r.k for r in spark.range(12).select(rng.golden(F.lit("abc"), F.col("id"), F.lit(5)).alias("k")).collect()}
    assert k == {1, 2, 3, 4, 5}


def test_losses(spark):
    x = [1.0, 2.0, float("-inf"), 0.5]
    df = spark.createDataFrame([(x, 1), (x, -100), ([0.0, float("-inf")], 0)], "x array<double>, t int")
    finite = [1.0, 2.0, 0.5]
    lse = math.log(sum(map(math.exp, finite)))
    ce, focal, smooth = ([r.l for r in df.select(metrics.loss(n, F.col("x"), F.col("t"), epsilon=e).alias("l")).collect()] for n, e in (("CE ", 0), ("focal", 0), ("ce", 0.1)))
    assert ce == [pytest.approx(lse - 2), None, pytest.approx(0)]
    assert focal[0] == pytest.approx((1 - math.exp(2 - lse)) ** 2 * (lse - 2)) and focal[1] is None
    assert smooth == [pytest.approx(0.9 * (lse - 2) + 0.05 * (2 * lse - 1.5)), None, pytest.approx(0)]
    with pytest.raises(ValueError):
        metrics.loss("hinge", F.col("x"), F.col("t"))
    empty = df.where("t = -100").select(metrics.cross_entropy(F.col("x"), F.col("t")).alias("l"))
    assert metrics.mean_loss(empty, "l").first().loss == 0


def test_empty_sentence_counts_as_correct(spark):
    tokens = spark.createDataFrame([(0, True), (0, False), (1, True)], "s int, ok boolean")
    sentences = spark.createDataFrame([(0,), (1,), (2,)], "s int")
    r = metrics.sentence_accuracy(tokens, sentences, "s", "ok").first()
    assert (r.sentences, r.correct) == (3, 2)


def test_weighted_mean(spark):
    df = spark.createDataFrame([(3.0, 2.0), (7.0, 5.0)], "n double, l double")
    assert df.agg(metrics.weighted_mean(F.col("l"), F.col("n")).alias("x")).first().x == pytest.approx(4.1)


def test_positions(spark):
    df = spark.createDataFrame([(4, 2), (3, 2)], "p int, s int")
    rows = df.select(ragged.query_positions(F.col("p"), F.col("s")).alias("q"), ragged.key_positions(F.col("p"), F.col("s")).alias("k")).collect()
    assert [q for r in rows for q in r.q] == [4, 5, 3, 4] and [k for r in rows for k in r.k] == [5, 6, 4, 5]


def test_two_phase_with_empty_prefix(spark):
    df = spark.createDataFrame([([], [7, 8, 9], [])], "p array<int>, s array<int>, a array<int>")
    r = df.select(*[c.alias(k) for k, c in ragged.two_phase(F.col("p"), F.col("s"), F.col("a"), 99).items()]).first()
    assert (r.full_prefix_ids, r.prefix_ids, r.suffix_ids, r.uncond_target_ids) == ([99], [99], [99, 7, 8], [-100])


def test_beam_against_all_paths(spark):
    bigrams = {(a, b): -random.Random(a * 31 + b).random() for a in range(-1, 9) for b in range(9)}
    lattice = [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    scores = spark.createDataFrame([(a, b, s) for (a, b), s in bigrams.items()], "prev int, id int, score double")
    allowed = spark.createDataFrame([(1, j, i) for j, ids in enumerate(lattice) for i in ids], "key long, position int, id int")
    steps = beam.step_scores(scores, allowed)

    def lp(prev, j, i):
        return bigrams[prev, i] - math.log(sum(math.exp(bigrams[prev, o]) for o in lattice[j]))

    got = beam.beam_search(steps, 3, 27).orderBy("rank").collect()
    paths = sorted(((sum(lp(p, j, i) for j, (p, i) in enumerate(zip((-1, *ids), ids, strict=False))), ids) for ids in itertools.product(*lattice)), key=lambda x: -x[0])
    assert [tuple(r.ids) for r in got] == [p[1] for p in paths]
    assert [r.score for r in got] == pytest.approx([p[0] for p in paths])
    greedy = beam.predict(steps, 3)["best"].first()
    want, prev = [], -1
    for j, ids in enumerate(lattice):
        prev = max(ids, key=lambda i, j=j, prev=prev: lp(prev, j, i))
        want.append(prev)
    assert list(greedy.ids) == want
    per = {r.position: r for r in beam.predict(steps, 3, 2)["per_position"].collect()}
    assert len(per) == 3 and all(len(r.ids) == 2 and r.probs == sorted(r.probs, reverse=True) for r in per.values())
    assert per[0].probs[0] == pytest.approx(max(math.exp(lp(-1, 0, i)) for i in lattice[0]))


def test_file_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jsonl").write_text('["a","b"]\n\n{"x":1}\nnot json\n  ["c"] \n[]\n', encoding="utf8")
    (tmp_path / "b.txt").write_text(" x \n\n y\n", encoding="utf8")
    assert sorted(r.sentences for r in sources.jsonl(spark, str(tmp_path)).collect()) == [[], ["a", "b"], ["c"]]
    assert sorted(r.sentences[0] for r in sources.text_lines(spark, str(tmp_path)).collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        sources.load(spark, str(tmp_path), "avrox")
    with pytest.raises(ValueError):
        sources.union([])
    df = spark.range(10)
    sources.write_shards(df, str(tmp_path / "out"), 3, "id", rows=2)
    parts = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).orderBy("shard").collect()
    assert [tuple(r)[1:] for r in parts] == [(0, 3, 4), (4, 6, 3), (7, 9, 3)]
    with pytest.raises(Exception, match="already exists"):
        sources.write_shards(df, str(tmp_path / "out"), 3, "id")


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello world, again."), (2, "x"), (3, "bon jour: été")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream_segments(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(segment_rows(docs).collect())
    q = stream_label_counts(spark, str(tmp_path / "in"), "doc_id long, text string", "label_counts")
    q.awaitTermination(120)
    assert sorted(spark.table("label_counts").collect()) == sorted(segment_rows(docs).groupBy("label").count().collect())


def test_two_phase_documents_encodes_whole_texts(spark, tmp_path):
    from glyphmill.plans import catalog

    long_ = " ".join(["the quick brown fox jumps over"] * 40)
    spark.createDataFrame([(i, long_) for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.QUERIES["two_phase_documents"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and max(r.n_prefix for r in rows) > 500
    for r in rows:
        letters = [catalog.ALPHABET.index(c) for c in long_ if c != " "][: r.n_prefix]
        assert r.full_prefix_ids == hashlib.md5(",".join(map(str, [26, *letters])).encode()).hexdigest()
