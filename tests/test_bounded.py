"""Steps whose work and memory are bounded by parts: the same results as the plain way, whatever the parts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.functions import lattice, lexicon, text
from glyphmill.operators import augment, ragged, segment, transform, vocab
from glyphmill.plans import catalog
from glyphmill.plans import functions as sqlapi

TEXTS = ["Hello [x] wörld, accent cygne GEL: it's 12 o'clock!!\nAgain", "", "zhang chang a", None, "x" * 300 + ", y" * 90, "aec" + "#" * 20 + "egg", "日本 語", "c"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_ratio_counts_as_the_negated_class_does(spark):
    share = F.when(F.length("text") > 0, F.length(text.keep_classes(F.col("text"), text.LATIN.ratio)) / F.length("text")).otherwise(0.0)
    assert all(r.a == r.b for r in texts(spark).select(text.ratio(F.col("text")).alias("a"), share.alias("b")).collect())
    _, plan = str(text.ratio(F.col("text"))), segment.runs_pattern(text.LATIN)
    assert "[^" not in plan


def test_letter_frequency_equals_frequency_of_words(spark):
    words = texts(spark).select(F.explode(F.regexp_extract_all("text", F.lit(f"([{text.LATIN.target}]+)"), F.lit(1))).alias("w")).select("w", text.readings(F.col("w")).alias("r"))
    want = {(r.ch, r.reading): (r.cnt, r.prob) for r in augment.frequency(words, "w", "r").collect()}
    got = {(r.ch, r.reading): (r.cnt, r.prob) for r in augment.letter_frequency(texts(spark), "text", text.readings).collect()}
    assert got == want and got["c", "s"][0] == 2 and ("g", "j") not in got and got["G", "j"][0] == 1


def test_letters_are_counted_by_the_letter_after_in_large_scripts():
    points = [chr(0x4E00 + i % 3000) for i in range(6001)]
    t = lattice.Texts(pa.array(["".join(points), "x"]))
    first, second, n = augment.pair_counts(t, t.points >= 0x4E00)
    assert n.sum() == 6001 and len(n) == 3001 and not (first == ord("x")).any() and n[second == 0].sum() == 1


def test_first_readings_are_those_of_each_word(spark):
    rows = spark.createDataFrame([(["accent", "egg", "c", "É"],), (["c", "ei"],), ([],), ([""],)], "w array<string>")
    one = F.flatten(F.transform("w", lambda w: F.transform(text.letter_readings(w), lambda r: r[0])))
    got = rows.select(text.first_readings(F.col("w")).alias("a"), one.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[1].a == ["k", "e", "i"]


def test_spans_read_the_words_of_their_suffix_only(spark):
    df = texts(spark).where("text <> ''").select("id", segment.segments(F.col("text")).alias("s"))
    plain = df.select("id", F.col("s.text").alias("text_list"), F.col("s.label").alias("labels"))
    told = df.select("id", segment.with_readings(F.col("s"), text.letter_readings).alias("s")).select("id", F.col("s.text").alias("text_list"), F.col("s.label").alias("labels"), F.flatten(F.transform("s.readings", lambda x: F.transform(x, lambda r: r[0]))).alias("pinyin_list"))
    for epoch in range(3):
        want = sorted(map(tuple, augment.suffixes(told, "id", "golden", epoch, 0.5).collect()))
        assert sorted(map(tuple, augment.suffixes(plain, "id", "golden", epoch, 0.5, firsts=text.first_readings).collect())) == want and len(want) > 3


def test_texts_are_read_once_for_frequencies(spark):
    plan = augment.letter_frequency(texts(spark), "text", text.readings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_spans_of_texts_are_those_of_their_segments(spark):
    df = segment.eligible(texts(spark)).select("id", segment.segments(F.col("text")).alias("s"))
    plain = df.select("id", F.col("s.text").alias("text_list"), F.col("s.label").alias("labels"))
    for strategy, epoch in (("golden", 0), ("golden", 2), ("random", 0)):
        want = sorted(map(tuple, augment.suffixes(plain, "id", strategy, epoch, 0.3, firsts=text.first_readings).collect()))
        assert sorted(map(tuple, augment.text_suffixes(texts(spark), "id", "text", strategy, epoch, 0.3, firsts=text.first_readings).collect())) == want and len(want) == 3


def test_rows_as_ids_in_one_pass(spark):
    ids = transform.Ids("abcdé", "abcdé 語", ("a", "b", "zh"))
    pairs = [("ab é", "cd"), ("", "abx"), ("??", "a"), ("語a", ""), ("x" * 50, "日"), (None, "a"), ("a", None), ("", "")]
    rows = spark.createDataFrame([(i, p, s, ["b", "zz"]) for i, (p, s) in enumerate(pairs)], "id int, prefix string, suffix string, readings array<string>")
    want = ragged.two_phase(vocab.encode(F.col("prefix"), ids.context), vocab.encode(F.col("suffix"), ids.context), vocab.encode_aligned(F.col("prefix"), ids.target), ids.begin)
    want |= {"postfix_ids": F.transform("readings", lambda r: vocab.known_or_nearest(r, list(ids.readings))), "target_ids": vocab.encode(F.col("suffix"), ids.target)}
    want = rows.select("id", *[c.alias(k) for k, c in want.items()])
    got = transform.encoded(rows, ids, "id")
    assert got.columns == want.columns
    filled = want.where("id not in (5, 6)").orderBy("id").collect()
    assert got.where("id not in (5, 6)").orderBy("id").collect() == filled and filled[2].prefix_ids == [7] and filled[2].uncond_target_ids == [-100]
    null = {r.id: r for r in got.where("id in (5, 6)").collect()}
    assert null[5].full_prefix_ids is None and null[5].prefix_lengths is None and null[5].target_ids == [0] and null[6].suffix_ids is None and null[6].prefix_ids == [7]
    shown = transform.encoded(rows, ids, "id", told=catalog.list_digests).orderBy("id").collect()
    plain = got.select("id", *[catalog.joined(F.col(c)).alias(c) if c.endswith("ids") and c != "postfix_ids" else c for c in got.columns[1:]]).orderBy("id").collect()
    assert shown == plain


def test_samples_without_lists_of_readings(spark):
    cut = segment.Cut(shortest=4, longest=6, soft=10, hard=90)
    df = texts(spark).where("text IS NOT NULL")
    want = segment.text_samples(df, "id", text.letter_readings, cut).collect()
    assert sorted(map(tuple, segment.text_samples(df, "id", None, cut, firsts=text.first_readings).collect())) == sorted(map(tuple, want)) and len(want) > 5
    assert segment.text_samples(df, "id", None, cut).columns == ["id", "start", "text_list", "labels"]


def test_lists_are_taken_up_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([[1] * 3, [], None, [1] * 9, [1]])], ["k", "s"])
    monkeypatch.setattr(segment, "SEGMENTS_AT_ONCE", 4)
    assert [p.column(0).to_pylist() for p in segment.list_parts(batch, 1)] == [[0, 1, 2], [3], [4]]


def test_encoding_knows_the_first_of_duplicates(spark):
    df = spark.createDataFrame([("abxa\U00020000",), ("",), (None,)], "t string")
    got = df.select(vocab.encode(F.col("t"), "ba\U00020000b").alias("a"), vocab.encode_aligned(F.col("t"), "ba\U00020000b").alias("b")).collect()
    assert [tuple(r) for r in got] == [([1, 0, 1, 2], [1, 0, -100, 1, 2]), ([], []), (None, None)]


def test_a_lexicon_in_blocks_cuts_as_a_whole_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    book = [("".join(rng.choice(list("abcd"), n)), int(rng.integers(1, 90))) for n in rng.integers(1, 9, 120)] + [("z" * 30, 50), ("z", 1), ("b", 7)]
    runs = ["".join(rng.choice(list("abcdz"), n)) for n in rng.integers(1, 60, 80)] + ["ab" + "z" * 30 + "cd", "", "a", "q", "qq"]
    lexicon = spark.createDataFrame(book, "word string, freq long")
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    want = {r.run: r.words for r in lattice.cut_runs(df, "run", lexicon).collect()}
    assert "z" * 30 in want["ab" + "z" * 30 + "cd"]
    monkeypatch.setattr(lattice, "MOST_CHARS", 10)
    for size in (20, 1 << 23):
        monkeypatch.setattr(lattice, "BLOCK_CHARS", size)
        assert {r.run: r.words for r in lattice.cut_runs(df, "run", lexicon).collect()} == want


def test_windows_as_lists_equal_the_table_function(spark):
    sqlapi.register(spark)
    sqlapi.register_lists(spark)
    texts(spark).createOrReplaceTempView("bounded")
    segs = "(SELECT id, text_segments(text) AS segs FROM bounded) d"
    want = spark.sql(f"SELECT id, w.* FROM {segs}, LATERAL text_windows(CAST(id AS STRING), d.segs) w").collect()
    got = spark.sql(f"SELECT id, w.* FROM {segs} LATERAL VIEW inline(text_window_list(CAST(id AS STRING), d.segs)) w AS start, text_list, labels").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 3


def test_entries_of_lists_hold_no_sizes(spark):
    from glyphmill.llm import jaccard

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60 + i % 2))) for i in range(4)], "doc_id long, text string")
    entries = jaccard.lists(docs, 3, jaccard.Scheme(90, 8))
    assert sorted(entries.columns) == ["a", "b", "sig"] and entries.where("a <> b").count() > 0
    assert len({r.root for r in jaccard.jaccard_components(docs).collect()}) == 1


def test_distinct_runs_are_those_of_the_pattern(spark, monkeypatch):
    want = {r.w for r in texts(spark).select(F.explode(F.regexp_extract_all("text", F.lit(f"([{text.LATIN.target}]+)"), F.lit(1))).alias("w")).collect()}
    for slice_, size in ((1 << 20, 1 << 25), (5, 40), (1, 1)):
        monkeypatch.setattr(segment, "SLICE", slice_)
        monkeypatch.setattr(segment, "RUN_BYTES", size)
        got = [r.run for r in segment.distinct_runs(texts(spark).union(texts(spark)).repartition(2), "text").collect()]
        assert len(got) == len(want) and set(got) == want and "x" * 300 in want
    assert segment.distinct_runs(texts(spark).where("id < 0"), "text").collect() == []
    assert set(segment.letters()) == {c for c in map(chr, range(0x300)) if c.isalpha() and c not in "ªµº" and ord(c) < 0x100}


def test_readings_are_ordered_as_nested_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # characters without readings (n, or dropped ones), phrases with too few readings, with null, and with readings that are not the characters' own
    table = {"a": ["x", "y", "x"], "b": ["y"], "c": ["ê"], "d": ["ê", "z", None], "語": ["z", "x", "y"], "e": None, "f": [], "ab": ["y", "x"], "ba": ["y", "y"], "cab": ["ê", "y", "y"], "d語": ["z"], "語n": ["y", "x"], "ad": [None, "z"], "語語": ["x", "y"]}
    book = lattice.phrase_book(spark.createDataFrame(list(table.items()), "phrase string, value array<string>"))
    words = ["", "n", "cn", *("".join(rng.choice(list("abcdef語n"), n)) for n in rng.integers(1, 12, 400))]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string").repartition(2)
    read = df.select("id", F.get(lattice.read(F.array("w"), book), F.lit(0)).alias("r"))
    nested = read.select("id", lexicon.nested_of(F.filter("r.best", lambda b: b.isNotNull()), F.col("r.own")).alias("n"))
    want = {r.id: (r.n, r.j) for r in nested.select("id", "n", F.transform("n", lambda x: F.array_join(x, "|")).alias("j")).collect()}
    monkeypatch.setattr(lattice, "SLICE", 50)
    got = {r.id: (r.n, r.j) for r in df.select("id", lattice.ordered(F.col("w"), book, lexicon.DROPPED).alias("n"), lattice.ordered(F.col("w"), book, lexicon.DROPPED, "|").alias("j")).collect()}
    assert got == want and want[0] == ([], []) and len({str(x) for x in want.values()}) > 200
    empty = lattice.phrase_book(spark.createDataFrame([], "phrase string, value array<string>"))
    assert all(r.n == [] for r in df.select(lattice.ordered(F.col("w"), empty, lexicon.DROPPED).alias("n")).collect())


def test_readings_in_context_read_the_texts_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts(spark).createOrReplaceTempView("counted_once")
    spark.createDataFrame([("accent egg",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(catalog, "docs", lambda *_: spark.table("counted_once").select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "id int, text string"))
    got = {r.word: r.readings for r in catalog.readings_in_context(spark, str(tmp_path)).collect()}
    assert seen.value == len(TEXTS)
    assert got["accent"] == "a,k|s,s|k,e,n,t" and got["cygne"] == "k|s,y,g|j,n,e" and got["egg"] == "e,g|j,g|j"
