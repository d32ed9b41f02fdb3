"""Readings, vocabularies, rows for training, sinks, configuration and the whole preprocessing run."""

import dataclasses
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill import __main__ as command
from glyphmill import sources
from glyphmill.functions import lexicon, text
from glyphmill.functions.once import running
from glyphmill.functions.profile import han
from glyphmill.operators import augment, metrics, ragged, segment, transform, vocab
from glyphmill.plans import config, preprocess
from glyphmill.sources import mds

CHARS = {"长": ["chang", "zhang"], "大": ["da"], "的": ["de", "di"], "欸": ["ê"], "我": ["wo"], "们": ["men"]}
BEST = {"长大": ["zhang", "da"], "长": ["chang"], "我们": ["wo", "men"], "欸大": ["ê", "da"]}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def reader(word):
    single = lexicon.lookup(CHARS)
    best = F.coalesce(F.try_element_at(lexicon.lookup(BEST), word), F.array().cast("array<string>"))
    return lexicon.nested(word, best, single)


def test_nested_readings(spark):
    assert value(spark, reader(F.lit("长大"))) == [["zhang", "chang"], ["da"]]
    assert value(spark, reader(F.lit("长"))) == [["chang", "zhang"]]
    # a character that is left out shifts the best readings of those after it, and one that is not the character's own is not used
    assert value(spark, reader(F.lit("欸大"))) == [["da"]]
    assert value(spark, reader(F.lit("x"))) == []
    assert value(spark, lexicon.flat(reader(F.lit("长大")))) == ["zhang", "da"]


def test_words_of_a_run(spark):
    assert value(spark, lexicon.words(F.lit("我们长大了"), ["我们", "长", "长大"])) == ["我们", "长大", "了"]
    assert value(spark, lexicon.words(F.lit("ab"), [])) == ["a", "b"]


def test_readings_on_segments_and_samples(spark):
    df = spark.createDataFrame([(1, "我们长大,x")], "k long, text string")
    cut = segment.Cut(shortest=1, longest=1, soft=8, hard=9)
    rows = segment.text_samples(df, "k", reader, cut, p=han()).collect()
    assert [(r.text_list, r.labels, r.pinyin_list) for r in rows] == [(["我们长大"], [1], ["wo", "men", "chang", "da"])]
    rows = segment.text_samples(spark.createDataFrame([(1, "长大,我们")], "k long, text string"), "k", reader, cut, p=han(), mode="char").collect()
    assert [p for r in sorted(rows, key=lambda r: r.start) for p in r.pinyin_list] == ["zhang", "da", "wo", "men"]


def test_conversion_and_vocabulary_filter(spark):
    assert value(spark, text.convert(F.lit("ab abc"), {"b": "d"}, {"abc": "X", "ab": "Y"})) == "Y X"
    assert value(spark, text.keep_vocabulary(F.lit("a𠮷b,c"), {"v": ["a", "𠮷"]}, "v", ",")) == "a𠮷,"
    with pytest.raises(ValueError):
        text.keep_vocabulary(F.lit("a"), {}, "v")
    assert value(spark, text.all_readings_in(F.array(F.lit("a")), ["a", "b"]))


def test_running_sums(spark):
    df = spark.createDataFrame([([3, 0, 2],), ([],), (None,), ([5],)], "n array<bigint>").coalesce(1)
    assert [r.x for r in df.select(running(F.col("n")).alias("x")).collect()] == [[0, 3, 3, 5], [0], [0], [0, 5]]


FREQUENCY = [("长", "chang", 7), ("长", "zhang", 3), ("的", "de", 8), ("的", "di", 2)]


def test_heteronyms_follow_the_frequencies(spark):
    table = augment.as_map(spark.createDataFrame(FREQUENCY, "ch string, reading string, cnt long"))
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.array(F.lit("长"), F.lit("我")).alias("c"), F.array(F.lit("chang"), F.lit("wo")).alias("r"))
    got = df.select(augment.heteronyms(F.col("c"), F.col("r"), table, 1.0, F.col("k")).alias("x")).collect()
    assert {r.x[1] for r in got} == {"wo"} and 0.27 < sum(r.x[0] == "zhang" for r in got) / 4000 < 0.33
    assert all(r.x == ["chang", "wo"] for r in df.select(augment.heteronyms(F.col("c"), F.col("r"), table, 0.0, F.col("k")).alias("x")).collect())


def test_train_and_validation_rows(spark):
    samples = spark.createDataFrame([("a", ["我们", ",", "长", "大"], [1, 0, 1, 1], ["wo", "men", "chang", "da"]), ("b", ["x"], [2], [])], "key string, text_list array<string>, labels array<int>, pinyin_list array<string>")
    ids = transform.Ids("我们长大的", "我们长大的,", ("chang", "da", "men", "wo", "zhang"))
    table = augment.as_map(spark.createDataFrame(FREQUENCY, "ch string, reading string, cnt long"))
    seen = set()
    for epoch in range(8):
        (r,) = transform.train(samples, "key", ids, table, epoch, forward=0.0).collect()
        seen.add(tuple(r.target_ids))
        prefix = {(0, 1): "", (2, 3): "我们,", (3,): "我们,长"}[tuple(r.target_ids)]
        assert r.prefix_lengths == len(prefix) and r.full_prefix_ids == [6, *("我们长大的,".index(c) for c in prefix)]
        assert r.prefix_ids == (r.full_prefix_ids[:-1] or [6]) and r.suffix_ids[0] == r.full_prefix_ids[-1] and len(r.suffix_ids) == len(r.target_ids)
        assert r.uncond_target_ids == ([-100] if not prefix else ["我们长大的".find(c) if c != "," else -100 for c in prefix])
        assert r.postfix_ids == [{"我": 3, "们": 2, "长": 0, "大": 1}["我们长大的"[i]] for i in r.target_ids]
    assert len(seen) == 3  # the golden sequence reaches every segment
    alone = augment.prepared(samples, "key", 1.0, frequency=table).first()
    assert alone.prefix == "" and alone.suffix in ("我们", "长大") and len(alone.readings) == 2
    broken = samples.withColumn("pinyin_list", F.array(F.lit("wo")))
    with pytest.raises(Exception, match="not aligned"):
        transform.train(broken, "key", ids, table, forward=0.0).collect()
    with pytest.raises(ValueError):
        augment.suffixes(samples, "key", "other")


def test_collated_rows(spark):
    df = spark.createDataFrame([(0, [1, 2], 5), (1, [], 6), (2, [3], 7)], "id long, v array<int>, n int")
    got = {r.batch: r for r in ragged.batches(df, "id", 2, "v", "n").collect()}
    assert (got[0].v_values, got[0].v_offsets, got[0].n, got[1].v_values) == ([1, 2], [0, 2, 2], [5, 6], [3])


def test_logical_prefix_positions(spark):
    df = spark.createDataFrame([(0, 3), (3, 0), (4, 1)], "start int, n int").coalesce(1)
    assert [x for r in df.select(ragged.logical_prefix(F.col("start"), F.col("n")).alias("x")).collect() for x in r.x] == [0, 1, 2, 4]


def test_tokenizer_from_config(spark, tmp_path):
    for name, lines in {"c.txt": "我\n们\n我\n", "x.txt": "我\n,\n\\n\n", "p.txt": "wo\nmen\n"}.items():
        (tmp_path / name).write_text(lines, encoding="utf8")
    t = vocab.Tokenizer.from_config(spark, {"chinese_vocab": "c.txt", "context_vocab": "x.txt", "pinyin_vocab": "p.txt", "special_tokens": ["bos"]}, str(tmp_path))
    assert t.sizes == {"chinese": 2, "pinyin": 2, "context_base": 3, "context": 4} and t.special == {"bos": 3}
    assert value(spark, t.encode(F.lit("我?,\n"))) == [0, 1, 2] and value(spark, t.encode(F.lit("我?"), "chinese", ignore=True)) == [0, -100]
    assert value(spark, t.decode(F.array(F.lit(1), F.lit(9), F.lit(0)))) == "们我" and value(spark, t.decode(F.array(F.lit(3), F.lit(0)), "context")) == "我"
    assert value(spark, t.encode_pinyin(F.array(F.lit("men"), F.lit("w"), F.lit("")))) == [1, 0, 0]
    with pytest.raises(ValueError):
        vocab.Tokenizer.from_config(spark, {"chinese_vocab": "c.txt"})
    assert sorted(map(tuple, sources.vocabulary_table(spark, str(tmp_path / "c.txt")).collect())) == [("们", 1), ("我", 0)]
    with pytest.raises(ValueError):
        sources.read_vocabulary(spark, str(tmp_path / "c.txt"), strict=True)
    with pytest.raises(FileNotFoundError):
        sources.read_vocabulary(spark, str(tmp_path / "none.txt"))


def test_rank_scale_and_mask(spark):
    assert value(spark, metrics.rank_scale(F.lit(3), F.lit(10), 2)) == pytest.approx(0.6)
    assert value(spark, metrics.masked(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(True), F.lit(False)))) == [1.0, float("-inf")]


@pytest.mark.parametrize("spread", [1, 7, 1000])
def test_top_of_groups(spark, spread):
    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"), (F.xxhash64("id") % spread).cast("double").alias("s"))
    got = sorted((r.g, -r.s, r.key) for r in metrics.top_of_groups(df, "g", "s", "key", 137, 16).collect())
    rows = sorted((r.g, -r.s, r.key) for r in df.collect())
    assert got == [x for g in range(3) for x in [r for r in rows if r[0] == g][:137]]


def test_mds_round_trip(spark, tmp_path):
    rows = [(f"{i}", "é" * (i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    n = mds.write_mds(df, str(tmp_path / "m"), limit=200)
    index = json.loads((tmp_path / "m/index.json").read_text())
    assert n == len(index["shards"]) > 3 and index["version"] == 2 and sum(s["samples"] for s in index["shards"]) == 50
    assert all(s["raw_data"]["bytes"] < 600 for s in index["shards"])
    assert sorted(map(tuple, mds.read_mds(spark, str(tmp_path / "m")).select("id", "text").collect())) == sorted(rows)


def test_small_files(spark, tmp_path):
    sources.write_package(spark, str(tmp_path / "pack"), {"a.json": '{"x": 1}', "b.txt": "é"})
    assert sources.json_object(spark, str(tmp_path / "pack/a.json")) == {"x": 1}
    with pytest.raises(FileExistsError):
        sources.write_package(spark, str(tmp_path / "pack"), {})
    with pytest.raises(ValueError):
        sources.json_object(spark, str(tmp_path / "pack/b.txt"))
    with pytest.raises(FileNotFoundError):
        sources.load(spark, str(tmp_path / "none"), "parquet")
    freq = spark.createDataFrame([("长", "chang", 0.7), ("长", "zhang", 0.3)], "ch string, reading string, prob double")
    sources.write_frequency(freq, str(tmp_path / "f.json"))
    assert sources.json_object(spark, str(tmp_path / "f.json")) == {"长": {"chang": 0.7, "zhang": 0.3}}
    for step in (1, 2):
        sources.log_metrics(spark.createDataFrame([(0.5,)], "loss double"), str(tmp_path / "log"), step)
    assert sorted(r.step for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]
    models = spark.createDataFrame([(0, ["b", "a"], ["k2", "k1"]), (1, ["c", "a"], ["k1", "k3"])], "position int, ops array<string>, keys array<string>")
    assert tuple(sources.merged_manifests(models, "ops", "keys").first()) == (["a", "b", "c"], ["k2", "k1", "k3"])


MODEL = {"model_dim": 8, "attn_dim": 8, "max_seqlen": 4, "mhsa_layers": 1, "mhsa_heads": 2, "ffn_common_dim": 8, "rope_theta": 1e4, "proj_size": 2}


def test_settings():
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}
    assert config.merge({"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": [3]}, "x": {}}) == {"a": {"b": [3]}}
    assert config.settled({"dataset_dir": '/x"\\y', "sources": [{"path": "${dataset.dataset_dir}/y ${other}"}]})["sources"] == [{"path": '/x"\\y/y ${other}'}]
    for bad in ({}, {"sources": [1], "segmentation": {"mode": "z"}}):
        with pytest.raises(ValueError):
            config.settled(bad)


PRE, POST = MODEL | {"vocab_size": 3, "mhca_heads": 2, "mhca_attn_dim": 4, "model_type": "one", "architectures": ["One"]}, MODEL | {"vocab_size": 2, "model_type": "two", "architectures": ["Two"]}
SEGMENT = {"vocab_size": 3, "model_dim": 2, "num_layers": 1, "kernel_size": 1, "ffn_dim": 2, "pad_token_id": 0, "model_type": "three", "architectures": ["Three"]}
SHAPES = {
    ("pre_model_pass1", "input", 0): [1, 4], ("pre_model_pass1", "input", 1): [1, 2, 1, 4, 2, 4], ("pre_model_pass2", "input", 0): [5, 1], ("pre_model_pass2", "input", 1): [1, 2, 5, 4, 2, 4],
    ("pre_model_pass2", "input", 3): [1, 2, 1, 4, 2, 2], ("pre_model_pass2", "input", 6): [9], ("pre_model_cross_kv", "input", 0): [1, 4, 8], ("pre_model_cross_kv", "output", 0): [1, 2, 1, 4, 2, 2],
    ("post_model", "input", 0): [1, 4], ("post_model", "output", 0): [1, 4, 8], ("post_model", "output", 1): [1, 4, 9], ("post_model", "output", 2): [1, 4, 9], ("forward", "input", 0): [1, 30], ("forward", "output", 0): [1, 29],
}
WHOLE = config.Package(
    PRE, POST, ["我", "们"], ["我", ","], ["wo", "men"], ["bos"], SEGMENT, ["<pad>", "<unk>", "a"], True, (3, 30), "v1-x", "v1-", 5,
    kinds={"pre": ("one", "One"), "post": ("two", "Two"), "segment": ("three", "Three")}, shapes=SHAPES,
)


def test_every_rule_of_a_package():
    """Each rule is broken by some package, and by itself where no other speaks of the same."""
    assert config.violations(WHOLE) == []
    with_ = lambda **more: dataclasses.replace(WHOLE, **more)
    broken = [with_(**{m: {**getattr(WHOLE, m), key: x}}) for m in ("pre", "post", "segment") for key in config.SIZES[m] for x in (0, True, "8")]
    broken += [with_(**{m: {**getattr(WHOLE, m), key: x}}) for m in ("pre", "post", "segment") for key, x in (("model_type", "z"), ("architectures", None))]
    broken += [with_(**{m: {**getattr(WHOLE, m), size: 9}}) for m, size, _ in config.MULTIPLES]
    broken += [with_(**{m: {**getattr(WHOLE, m), "rope_theta": x}}) for m in ("pre", "post") for x in (-1.0, None)]
    broken += [with_(post={**POST, "model_dim": 16}), with_(post={**POST, "rope_theta": 5.0}), with_(post={**POST, "vocab_size": 7}), with_(pre={**PRE, "vocab_size": 7}), with_(pre={**PRE, "proj_size": 7}), with_(post={**POST, "proj_size": 7})]
    broken += [with_(chinese=["我", "我"]), with_(context=[]), with_(pinyin=["wo", "wo"]), with_(special=[]), with_(special=["x", "x"]), with_(special=[","])]
    broken += [with_(version="v2"), with_(batch=0), with_(cache_dtype="float16"), with_(segment_tokens=None), with_(segment_model=False), with_(segment_tokens=["<pad>", "a", "b"]), with_(segment_tokens=["<pad>", "<unk>", "é"])]
    broken += [with_(segment_tokens=["<pad>", "<unk>", "a", "b"]), with_(segment_tokens=["<pad>", "<unk>", "<unk>"]), with_(segment={**SEGMENT, "pad_token_id": 3}), with_(segment_limits=(2, 9)), with_(segment_limits=(9, 8)), with_(segment_limits=(3, 31))]
    broken += [with_(shapes={**SHAPES, key: [1]}) for key in SHAPES]
    found = [config.violations(p) for p in broken]
    assert all(found)
    assert {text for x in found for text in x} == {text for text, _ in config.RULES}
    assert ["caches have a known type"] in found and ["the batch has rows", *found[broken.index(with_(batch=0))][1:]] in found
    plain = (["我", "们"], ["我", ","], ["wo", "men"], ["bos"])
    config.check_package(PRE, POST, *plain, limits=(3, 9))
    with pytest.raises(ValueError, match="attn_dim is a multiple.*vocab_size"):
        config.check_package(PRE | {"attn_dim": 9, "vocab_size": 4}, POST, *plain)


def test_program_headers(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0\0\0\0ET12" + b"x" * 9)
    (tmp_path / "b.bin").write_bytes(b"\0\0\0\0ET13" + b"x" * 9)
    (tmp_path / "c.bin").write_bytes(b"\0\0\0\0ET12")
    assert {r.path[-5]: r.is_program for r in config.program_headers(spark, str(tmp_path)).collect()} == {"a": True, "b": False, "c": False}


def test_preprocess_does_not_depend_on_files(spark, tmp_path):
    """One file and seven, copies of one text among them: the same samples, split, frequencies and prepared rows."""
    lines = [f"The quick brown fox number {'abcdefgh'[i % 8]}, jumps over the {'lazy' * (i % 3)} dog; and goes on" for i in range(30)] + ["Again and again, the same words here"] * 12
    df = spark.createDataFrame([(x, None) for x in lines], "t string, u string")
    made = []
    for n in (1, 7):
        df.repartition(n).write.parquet(str(tmp_path / f"p{n}"))
        (tmp_path / f"j{n}").mkdir()
        for i in range(n):
            (tmp_path / f"j{n}/{i}.txt").write_text("\n".join(lines[i::n]), encoding="utf8")
        c = {"dataset_dir": str(tmp_path / f"out{n}"), "sources": [{"kind": "parquet", "path": str(tmp_path / f"p{n}"), "columns": ["t", "u"]}, {"kind": "text", "path": str(tmp_path / f"j{n}")}], "split": {"train": 0.7}, "windows": {"shortest": 8, "longest": 12, "soft": 30, "hard": 60}, "validation": {"confusion": 0.5}}
        out = preprocess.run(spark, c, text.letter_readings, allow=" .")
        made.append({k: sorted(map(repr, v.collect())) for k, v in out.items()})
        # frequencies are those of all samples
        rows = [*out["train"].collect(), *out["validation"].collect()]
        count = Counter((ch, p) for r in rows for ch, p in zip((c for t, label in zip(r.text_list, r.labels) if label == 1 for c in t), r.pinyin_list))
        assert {(r.ch, r.reading): r.cnt for r in out["frequency"].collect()} == count
        total = out["totals"].first()
        assert (total.samples, total.chars) == (len(rows), sum(len(t) for r in rows for t in r.text_list))
        assert sorted(r.id for r in mds.read_mds(spark, str(tmp_path / f"out{n}/train")).collect()) == sorted(r.id for r in out["train"].collect())
    assert made[0] == made[1]
    ids = transform.Ids("abcdefghijklmnopqrstuvwxyzT", "abcdefghijklmnopqrstuvwxyzT ,;", tuple("abcdefghijklmnopqrstuvwxyz"))
    freq = augment.as_map(out["frequency"])
    path = str(tmp_path / "out7/train")
    epoch = transform.epoch_rows(spark, path, "id", ids, freq, 2, block=4, confusion=0.2).orderBy("position").collect()
    rest = transform.epoch_rows(spark, path, "id", ids, freq, 2, skip=5, block=4, confusion=0.2, tasks=3).orderBy("position").collect()
    assert epoch[5:] == rest and [r.position for r in epoch] == list(range(len(epoch))) and len({r.id for r in epoch}) == out["train"].count()


def test_preprocess_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["The quick brown fox, jumps over the lazy dog: and goes on and on", "Pack my box with five dozen jugs; of liquor and again some more"]
    (tmp_path / "in/a.jsonl").write_text("\n".join(json.dumps([x, y]) for x in lines for y in lines) + "\n[]\nbroken\n", encoding="utf8")
    (tmp_path / "in/b.txt").write_text("\n".join(f"{x} and a tail" for x in lines), encoding="utf8")
    spark.createDataFrame([(lines[0], None, 1)], "t string, u string, n int").write.parquet(str(tmp_path / "p"))
    out = str(tmp_path / "out")
    c = {"dataset_dir": out, "sources": [{"kind": "jsonl", "path": str(tmp_path / "in")}, {"kind": "text", "path": str(tmp_path / "in")}, {"kind": "parquet", "path": str(tmp_path / "p"), "columns": ["t", "u", "w"]}], "split": {"train": 0.7}, "windows": {"shortest": 8, "longest": 12, "soft": 30, "hard": 60}}
    made = preprocess.run(spark, c, text.letter_readings, allow=" .")
    n = {k: v.count() for k, v in made.items()}
    assert n["train"] > n["validation"] > 0 and n["prepared"] == n["validation"] == round((n["train"] + n["validation"]) * 0.3)
    assert mds.read_mds(spark, f"{out}/train").count() == n["train"]
    assert sum(sources.json_object(spark, f"{out}/frequency.json")["c"].values()) == pytest.approx(1)
    rows = spark.read.parquet(f"{out}/validation").collect()
    assert len(rows) == n["prepared"] and all(len(r.readings) == len(r.suffix) > 0 for r in rows)
    with pytest.raises(ValueError):
        preprocess.run(spark, c | {"sources": [{"kind": "x", "path": "y"}]}, text.letter_readings)
    (tmp_path / "c.json").write_text(json.dumps(c | {"dataset_dir": f"{out}2"}))
    command.main(["preprocess", str(tmp_path / "c.json")])
    assert mds.read_mds(spark, f"{out}2/train").count() == n["train"]
