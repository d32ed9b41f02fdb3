"""Lexicons: the likeliest words of a run, leftmost longest phrases, readings in context, candidate rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import lattice, lexicon, text
from glyphmill.functions.profile import OTHER, PAUSE, TARGET, han
from glyphmill.operators import segment, vocab


def brute_words(run, freq):
    """All cuts: the cheapest, and of those that cost the same the one with the longest first words."""
    total = sum(freq.values())
    cost = lambda w: round(lattice.SCALE * (math.log(total) - math.log(freq.get(w, 1)))) if w in freq or len(w) == 1 else None
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        words = [run[a:z] for a, z in zip(at, at[1:])]
        if any(cost(w) is None for w in words):
            continue
        key = (sum(map(cost, words)), [-len(w) for w in words])
        best = min(best or (key, words), (key, words))
    return best[1]


@pytest.mark.parametrize("joined", [False, True])
def test_likeliest_words(spark, monkeypatch, joined):
    r = random.Random(4)
    alphabet = "ab語𠮷"
    freq = {"".join(r.choices(alphabet, k=r.choice([1, 2, 2, 3, 4]))): r.choice([1, 2, 4, 8, 50]) for _ in range(25)}
    runs = sorted({"".join(r.choices(alphabet, k=r.randrange(1, 10))) for _ in range(150)})
    book = spark.createDataFrame(list(freq.items()), "word string, freq long")
    if joined:
        monkeypatch.setattr(lattice, "MOST_CHARS", 0)
    got = lattice.cut_runs(spark.createDataFrame([(x,) for x in runs], "run string").repartition(3), "run", book).collect()
    assert {x.run: x.words for x in got} == {x: brute_words(x, freq) for x in runs}


def test_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_CHARS", 3)
    with pytest.raises(ValueError):
        lattice.word_book(spark.createDataFrame([("abcd", 1)], "word string, freq long"))
    with pytest.raises(ValueError):
        lattice.phrase_book(spark.createDataFrame([("abcd", "x")], "phrase string, value string"))


def test_segments_by_a_lexicon_of_100000_words(spark):
    words = spark.range(100_000).select(F.translate(F.conv(F.col("id") + 7_000, 10, 20), "0123456789", "klmnopqrst").alias("word"), (F.col("id") % 90 + 1).alias("freq"))
    words = words.select(F.lower("word").alias("word"), "freq")
    book = lattice.word_book(words)
    known = {r.word: r.freq for r in words.collect()}
    assert len(known) == 100_000
    r = random.Random(1)
    texts = ["".join(r.choices(sorted(known)[:50_000], k=5)) + ", " + r.choice(sorted(known)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = df.select("id", "text", segment.segments(F.col("text"), words=book).alias("s"), segment.segments(F.col("text")).alias("whole")).collect()
    for x in rows:
        assert "".join(s.text for s in x.s) == "".join(s.text for s in x.whole) and [s.text for s in x.s if s.label != TARGET] == [s.text for s in x.whole if s.label != TARGET]
        assert all(s.text in known or len(s.text) == 1 for s in x.s if s.label == TARGET)
    assert sum(s.label == TARGET for x in rows for s in x.s) > 2 * sum(s.label == TARGET for x in rows for s in x.whole)
    with pytest.raises(ValueError):
        segment.segments(F.col("text"), mode="z")


def test_segments_of_odd_rows(spark):
    book = lattice.word_book(spark.createDataFrame([("我们", 5), ("长大", 3), ("大", 1), ("", 9), (None, 1)], "word string, freq long"))
    df = spark.createDataFrame([(0, "我们长大了,ok!我们"), (1, ""), (2, "..."), (3, None)], "id long, text string")
    rows = {r.id: r.s for r in df.select("id", segment.segments(F.col("text"), han(), words=book).alias("s")).collect()}
    assert [(s.text, s.label) for s in rows[0]] == [("我们", 1), ("长大", 1), ("了", 1), (",", 0), ("ok", 2), ("!", 0), ("我们", 1)]
    assert not rows[1] and [(s.text, s.label) for s in rows[2]] == [("...", OTHER)] and not rows[3]
    assert df.where("id < 0").select(segment.segments(F.col("text"), han(), words=book)).collect() == []
    assert PAUSE == 0


def brute_replaced(t, table):
    out, i = "", 0
    while i < len(t):
        hit = max((p for p in table if t.startswith(p, i)), key=len, default=None)
        out += table[hit] if hit else t[i]
        i += len(hit) if hit else 1
    return out


def test_phrases_are_replaced_once(spark, monkeypatch):
    r = random.Random(9)
    # overlapping phrases, and values that hold other phrases
    table = {"ab": "bc", "bc": "ab", "abc": "ab", "b": "abc", "c語": "", "語𠮷語": "c", "a": "𠮷", "bca": "語語"}
    texts = ["".join(r.choices("abc語𠮷 ", k=r.randrange(0, 40))) for _ in range(300)] + ["", None, "abcab"]
    monkeypatch.setattr(lattice, "SLICE", 100)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    book = lattice.phrase_book(spark.createDataFrame(list(table.items()), "phrase string, value string"))
    got = {x.id: x for x in df.select("id", lattice.replaced(F.col("t"), book).alias("x"), text.convert(F.col("t"), {"a": "𠮷", "b": "abc"}, {k: v for k, v in table.items() if len(k) > 1}).alias("y")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else brute_replaced(t, table)
        assert got[i].x == want and got[i].y == want
    empty = lattice.phrase_book(spark.createDataFrame([], "phrase string, value string"))
    assert [x.x for x in df.where("id = 302").select(lattice.replaced(F.col("t"), empty).alias("x")).collect()] == ["abcab"]


READ = {"长": ["chang", "zhang"], "大": ["da"], "的": ["de", "di"], "欸": ["ê"], "我": ["wo"], "们": ["men"], "长大": ["zhang", "da"], "我们": ["wo", "men"], "大的": ["da", "di"], "欸大": ["ê", "da"]}


def test_readings_in_context(spark):
    book = lattice.phrase_book(spark.createDataFrame(list(READ.items()), "phrase string, value array<string>"))
    df = spark.createDataFrame([(["长大的", "长x", "", "大的"],), ([],), (None,)], "w array<string>")
    rows = [r.r for r in df.select(lattice.read(F.col("w"), book).alias("r")).collect()]
    assert [x.best for x in rows[0]] == [["zhang", "da", "de"], ["chang", None], [], ["da", "di"]]
    assert [x.own for x in rows[0][:2]] == [[["chang", "zhang"], ["da"], ["de", "di"]], [["chang", "zhang"], None]]
    nested = df.select(F.explode(lattice.read(F.col("w"), book)).alias("r")).select(lexicon.nested_of(F.filter("r.best", lambda b: b.isNotNull()), F.col("r.own")).alias("n")).collect()
    assert [r.n for r in nested] == [[["zhang", "chang"], ["da"], ["de", "di"]], [["chang", "zhang"]], [], [["da"], ["di", "de"]]]


def test_samples_by_words_and_readings(spark):
    readings = lattice.phrase_book(spark.createDataFrame(list(READ.items()), "phrase string, value array<string>"))
    words = lattice.word_book(spark.createDataFrame([("我们", 5), ("长大", 3), ("欸", 2)], "word string, freq long"))
    df = spark.createDataFrame([(1, "我们长大,欸们们ab")], "k long, text string")
    cut = segment.Cut(shortest=4, longest=4, soft=40, hard=90)
    for mode, wanted in (("word", ["我们", "长大", ",", "们", "们", "ab"]), ("char", [*"我们长大,们们", "ab"])):
        rows = segment.text_samples(df, "k", readings, cut, p=han(), mode=mode, words=words).collect()
        assert [t for r in sorted(rows, key=lambda r: r.start) for t in r.text_list] == [t for t in wanted if t != ","] or [t for r in rows for t in r.text_list] == wanted
        assert [p for r in sorted(rows, key=lambda r: r.start) for p in r.pinyin_list] == ["wo", "men", "zhang", "da", "men", "men"]
        assert all(len(r.pinyin_list) == sum(len(t) for t, label in zip(r.text_list, r.labels) if label == TARGET) for r in rows)


def test_candidate_rows(spark):
    said = spark.createDataFrame([("长", "zhang"), ("长", "chang"), ("中", "zhong"), ("人", "ren")], "ch string, reading string")
    names = ["zhang", "zh", "z", "chang", "c", "zhong", "ren", "xx"]
    tokens = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, id int")
    chars = spark.createDataFrame([("中", 2), ("长", 0), ("人", 1)], "ch string, char_id int")
    table = vocab.candidate_table(vocab.possibilities(said, tokens), tokens, chars)
    rows = {names[r.id]: (r.ids, r.mask, r.width) for r in table.collect()}
    assert rows["z"] == ([0, 2], [True, True], 2) and rows["zh"] == rows["z"] and rows["chang"] == ([0, 0], [True, False], 2)
    assert rows["xx"] == ([0, 0], [False, False], 2) and len(rows) == len(names)
    alone = vocab.candidate_table(vocab.possibilities(said.limit(0), tokens), tokens, chars).collect()
    assert all((r.ids, r.mask, r.width) == ([0], [False], 1) for r in alone)
    sequences = spark.createDataFrame([("a", [2, 6, 7]), ("b", []), ("c", [2, 2])], "k string, t array<int>")
    got = {r.k: (r.ids, r.mask) for r in vocab.gathered(sequences, "k", "t", table).collect()}
    assert got["a"] == ([[0, 2], [1, 0], [0, 0]], [[True, True], [True, False], [False, False]]) and got["b"] == ([], []) and got["c"][0] == [[0, 2], [0, 2]]
    with pytest.raises(Exception, match="no candidates of id 99"):
        vocab.gathered(spark.createDataFrame([("a", [99])], "k string, t array<int>"), "k", "t", table).collect()
    logits = spark.range(1).select(vocab.candidate_logits(F.array(*map(F.lit, [0.5, 1.5, 2.5])), F.array(F.lit(0), F.lit(2), F.lit(0)), F.array(F.lit(True), F.lit(True), F.lit(False))).alias("x")).first().x
    assert logits == [0.5, 2.5, -np.inf]
