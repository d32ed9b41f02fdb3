"""The functions of Spark SQL against the operators that they stand for."""

from pyspark.sql import functions as F

from glyphmill.functions import rng, text
from glyphmill.operators import segment, vocab
from glyphmill.plans.functions import definitions, register

TEXTS = ["Hello [x] wörld, a  b c: it's 12 o'clock!!\nAgain", "", "zhang chang a", None, "x" * 300 + ", y" * 90, "'quoted' \\ back", "日本 語"]


def test_functions_equal_the_operators(spark):
    assert set(register(spark)) == set(definitions()) | {"text_windows"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    df.createOrReplaceTempView("texts")
    t = F.col("t")
    pairs = {
        "strip_brackets(t)": text.strip_brackets(t), "join_spaced(t)": text.join_spaced(t), "keep_text(t)": text.keep_classes(t, text.LATIN.target + text.LATIN.pause), "target_ratio(t)": text.ratio(t),
        "text_runs(t)": segment.runs(t), "text_segments(t)": segment.segments(t), "syllable_initial(t)": text.initial(t), "syllable_final(t)": text.final(t), "shorthands(t)": text.shorthands(t),
        "draw('3', 'x', t)": rng.uniform(3, "x", t), "golden(t, id, 5)": rng.golden(t, F.col("id"), F.lit(5)), "vocabulary_ids(t, 'abch')": vocab.encode(t, "abch"), "vocabulary_aligned(t, 'abch')": vocab.encode_aligned(t, "abch"),
    }
    mine = spark.sql(f"SELECT id, {', '.join(f'{k} AS c{i}' for i, k in enumerate(pairs))} FROM texts").collect()
    theirs = df.select("id", *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).collect()
    by = {r.id: r for r in theirs}
    for r in mine:
        for i, name in enumerate(pairs):
            if TEXTS[r.id] is not None:
                assert r[f"c{i}"] == by[r.id][f"c{i}"], (name, TEXTS[r.id])


def test_windows_by_lateral_join(spark):
    register(spark)
    cut = segment.Cut(seed=4, shortest=3, longest=9, soft=12, hard=40)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id int, t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, w.* FROM (SELECT id, text_segments(t) AS segs FROM texts) d, LATERAL text_windows(CAST(id AS STRING), d.segs, 4, 3, 9, 12, 40) w").collect()
    want = segment.windows(df.where("t IS NOT NULL").select("id", segment.segments(F.col("t")).alias("s")), "id", "s", cut).collect()
    assert sorted((r.id, r.start, r.text_list, r.labels) for r in got) == sorted((r.id, r.start, r.text_list, r.labels) for r in want) and len(got) > 10
