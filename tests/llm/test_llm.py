"""The training-data operators against brute force, on small fixtures with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat, common, containment, jaccard, pii, queries, rans, suffix, winnow
from glyphmill.llm.containment import decontaminate, with_leaks
from glyphmill.llm.debruijn import debruijn_dedup
from glyphmill.llm.graph import components
from glyphmill.llm.jaccard import jaccard_components, keep_one
from glyphmill.llm.linefreq import cleaned, line_quality
from glyphmill.llm.mixing import flight, landing, mix_sources, take, with_targets
from glyphmill.llm.quality import classify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag long, key string, rank int, at long, places string, score string, leaks string, sig string, `_id` string"
SPACE = r"[^\x20\x09-\x0D]+"


def corpus():
    """Random prose with copies, near copies, shared passages, and the cases that break things."""
    r = random.Random(3)
    lexicon = [f"w{i}" for i in range(300)] + ["Été", "naïve", "語"]
    words = lambda n: [r.choice(lexicon) for _ in range(n)]
    passage, line = words(60), " ".join(words(9))
    texts = [" ".join(words(r.choice([5, 30, 90, 400]))) for _ in range(40)]
    texts += [texts[3]] * 3 + [" ".join(words(20) + passage + words(15)) for _ in range(5)]
    for i in (5, 6, 7, 8):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append("  ".join(w) + "\n")
    texts += ["\n".join([" ".join(words(30)), line, line]) for _ in range(6)]
    texts += [None, "", " \t\n", "a", " A ", "a b a b a b " * 60, "z" * 900, "x\0y" * 100, "ab" * 30_000, "mail a.b@c.de 10.0.0.1 4111 1111-1111 1111 +1 (555) 123-4567 x@y 1.2.3.999"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, 5, "k", 1, 2, "p", "s", "l", "g", "i") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[10], (None, texts[5], *rows[0][2:]), (None, "no id " * 30, *rows[0][2:])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def units(rows):
    """Distinct (doc_id, text), in order; null ids first."""
    return sorted({(r[0] is not None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})


def by_row(found, *columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in found)


def expected(rows, answer):
    return sorted((repr(r[0]), *map(repr, answer[(r[0] is not None, r[0] or 0, r[1] or "", r[1] is None)])) for r in rows)


def test_debruijn(docs, rows):
    seen, answer = set(), {}
    for u in units(rows):
        w = u[2].encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        answer[u] = (b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone))
    assert by_row(debruijn_dedup(docs).collect(), "doc_id", "text", "n_words", "n_removed") == expected(rows, answer)


@pytest.mark.parametrize("hot", [40_000, 1])
def test_suffix(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    counts, answer = Counter(), {}
    for u in units(rows):
        b = u[2].encode()
        counts.update(b[p : p + 200] for p in range(len(b) - 199))
    for u in units(rows):
        b = u[2].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if counts[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        answer[u] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), len(re.findall(b"\1+", gone)))
    found = suffix.suffix_dedup(docs).select("*", F.size("spans").alias("n_spans")).collect()
    assert by_row(found, "doc_id", "content", "n_bytes", "n_removed", "n_spans") == expected(rows, answer)


def test_two_stage_is_a_suffix_array():
    r = np.random.default_rng(2)
    for _ in range(30):
        text = np.append(r.integers(1, 4, r.integers(1, 300)), 0).astype(np.uint8)
        wanted = np.append(np.ones(len(text) - 1, bool), False)
        order, common = suffix.two_stage(text, wanted, 400)
        body = text.tobytes()
        assert order.tolist() == sorted(range(len(text) - 1), key=lambda i: body[i:])
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            x, y = body[a:] + bytes(500), body[b:] + bytes(500)
            assert n == min(400, next(i for i in range(501) if i == 500 or x[i] != y[i])) or x[: len(body)] == y[: len(body)]


def test_rans_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 1000, 70_000):
        ids = np.minimum(r.geometric(0.02, n), 499)
        coder = rans.Rans(rans.scaled(np.bincount(ids, minlength=500), 12), 12)
        frame = coder.encode(ids, 256)
        assert coder.decode(frame).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        coder.decode(frame[:200] + bytes([frame[200] ^ 1]) + frame[201:])
    a, b = b"hello", b"world" * 9
    assert rans.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_tokens(spark, docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = rans.tokenizer_path(spark)
    more = [(-1, "  a  b\n\n c <|endoftext|> x 's don't\x1c \x1cz  "), (-2, "The\x85 end  of　x 12,3 $#@! ..  ..'s a.\nB")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_blocks(*rans.write_blocks(df, path, block=1 << 10, lanes=16)).collect())
    tokenizer = tokenizers.Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, t in [(r[0], r[1]) for r in rows] + more:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (i is not None, i or 0))
    start = 0
    for g in got:
        assert g[0] == start
        start += g[2]
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((g[2], g[3]) for g in got if g[1] == k) for k in want}


def test_files_decode_in_another_process(spark, docs, rows, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = rans.tokenizer_path(spark)
    rans.write_blocks(docs, path, block=1 << 10, lanes=16, to=str(tmp_path / "t"))
    code = """
import sys, zlib, numpy as np, pyarrow.parquet as pq
from glyphmill.llm import rans
h = pq.read_table(sys.argv[1] + "/header").to_pylist()[0]
coder = rans.coder_of(h["bits"], h["ids"], h["frequencies"])
blocks = sorted(pq.read_table(sys.argv[1] + "/blocks").to_pylist(), key=lambda b: (b["shard"], b["first"]))
print(zlib.crc32(np.concatenate([coder.decode(b["frame"]) for b in blocks]).astype("<u4").tobytes()), h["tokenizer"])
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path / "t")], capture_output=True, text=True, check=True, cwd=root).stdout.split()
    tokenizer = tokenizers.Tokenizer.from_file(path)
    order = [(r.doc_id, r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).orderBy(F.asc_nulls_first("doc_id"), "tie").collect()]
    ids = [i for _, t in order for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    assert said == [str(zlib.crc32(np.array(ids, "<u4").tobytes())), os.path.basename(path)]


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "us|>\ner", "&lt;<|a|>\n&amp;\n"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "q"), (None, None, "assistant", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    found = defaultdict(list)
    for r in chat.prefix_examples(df).select("conv_id", "example", "last", chat.loss_text().alias("loss"), chat.read_turns(F.col("text")).alias("turns")).collect():
        found[r.conv_id].append(r)
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] or -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        got = sorted(found[conv], key=lambda r: r.example)
        assert [(t.role, t.text) for t in got[-1].turns] == [t[1:] for t in turns] and [r.last for r in got] == [False] * (len(got) - 1) + [True]
        assert [r.loss for r in got if r.loss or r.turns[-1].role == "assistant"] == [t[2] for t in turns if t[1] == "assistant"]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, docs, rows):
    more = [(-1, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 " + "1 2 " * 3000), (-2, "9" * 5000 + " " + "a." * 3000 + "@")]
    more += [(-10 - i, f"token: acct {4111111111111111 if i < 9 else 77001234500 + i} done " + "plain words") for i in range(12)]
    df = docs.select("doc_id", "text", "tag", "places").unionByName(spark.createDataFrame([(*m, 1, "") for m in more], "doc_id long, text string, tag long, places string"))
    found = pii.extract(df).collect()
    texts = [(r[0], r[1]) for r in rows] + more
    want = sorted(repr((i, [[m.span() for m in re.finditer(p, t or "") if good(k, m.group())] for k, p in BASE.items()])) for i, t in texts)
    assert sorted(repr((r.doc_id, [[(s.start, s.end) for s in r[k]] for k in BASE])) for r in found) == want
    more_found = {r.doc_id: [dict(more)[r.doc_id][s.start : s.end] for s in r.found] for r in found if r.doc_id is not None and r.doc_id <= -10}
    assert not any(more_found[-10 - i] for i in range(9))  # overlaps a fixed span


def test_pii_discovers_by_context(spark):
    rows = [(i, f"see card 411111111111{1111} ok") for i in range(1)]
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "378282246310005", "6011111111111117", "3530111333300000"]
    rows = [(i, f"my card {c} is lost") for i, c in enumerate(cards)] + [(100, "my card 4111111111111112 is lost"), (101, "in year 20240 nothing")]
    found = {r.doc_id: [(s.start, s.end) for s in r.found] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == [(8, 24)] and not found[101] and not found[0]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    """The corpus as tables, as the queries read them."""
    root = str(tmp_path_factory.mktemp("tables"))
    docs = [r[:5] for r in rows] + [(500, 'key = "9f86d081884c7d659a2feaa0c55ad015"! a@b.cd 10.1.2.3 4111111111111111 +1 555 123 4567', "en", "s1", 1)]
    docs += [(501 + i, f'key = "{i}f86d081884c7d659a2feaa0c55ad01{i}"', "en", "s1", 1) for i in range(3)] + [(504, "sum 0f86d081884c7d659a2feaa0c55ad0ff alone", "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", "hi &lt; <|x|>"), (1, 1, "assistant", "a[b]"), (1, 2, "user", None), (1, 3, "assistant", "&amp;"), (2, 0, "system", "s"), (2, 1, "user", "only"), (3, 0, "assistant", None), (3, 1, "assistant", said)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, docs, turns


def test_query_op3(spark, stored):
    root, _, turns = stored
    said = "</s>[INST] ok [/INST]"
    turns = turns + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op3_prefix_chat(spark, root).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {-7, 1, 2, 3}
    for i, r in got.items():
        mine = [(role, t or "") for c, _, role, t in turns if c == i]
        trained = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha("".join(f"{a}\n{t}\n" for a, t in mine)), len(trained), sha(trained))
        assert r.formatted_chars >= sum(len(t) for _, t in mine)


def test_query_op5(spark, stored):
    root, docs, _ = stored
    got = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in queries.op5_pii(spark, root).collect())
    want = []
    for i, t, *_ in docs:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if good(k, m.group())]
        listed = [f"{k}:{a}:{z}" for k, a, z in spans]
        n = Counter(k for k, _, _ in spans)
        more = ["id:7:39"] if i in (500, 501, 502, 503) else []
        want.append((repr(i), *(n[k] for k in BASE), hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + more)))
    assert got == sorted(want)


def test_query_op7(spark, stored):
    root, docs, _ = stored
    got = queries.op7_quality(spark, root).collect()
    assert sorted((repr(r.doc_id), r.held_out) for r in got) == sorted((repr(d[0]), d[0] is not None and zlib.crc32(str(d[0]).encode()) % 4 == 2) for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_query_op10(spark, stored):
    root, docs, _ = stored
    got = queries.op10_cube_mix(spark, root).collect()
    size = lambda t: len(re.findall(SPACE, t or ""))
    assert sorted((repr(r.doc_id), r["size"]) for r in got) == sorted((repr(d[0]), size(d[1])) for d in docs)
    total = Counter()
    for d in docs:
        total[d[3]] += size(d[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    low, high = 0.0, 3.0 * sum(total.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * (1 + j % 3), 3 * total[s]) for j, s in enumerate(order)) < sum(total.values()) else (low, mid)
    want = {total[s]: min(high * (1 + j % 3), 3 * total[s]) for j, s in enumerate(order)}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source_size]) and r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    assert all(abs(taken[k] - t) <= 0.02 * t + 5 for k, t in want.items())


def test_pii_discovers_secrets(spark):
    r = random.Random(17)
    code = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    long_, short = [code(40) for _ in range(12)], [f"9{code(10)}7a" for _ in range(6)]
    prose = lambda n: " ".join(r.choice(["river", "stone", "in", "the", "over"]) for _ in range(n))
    rows = [(i, f'{prose(5)} token = "{c}" {prose(4)}') for i, c in enumerate(long_ + short)] + [(100 + i, f"{prose(4)} room {i} in 19{i}0 {prose(3)}") for i in range(40)] + [(200, "1 2 " * 20_000), (201, None), (202, "")]
    found = {x.doc_id: [dict(rows)[x.doc_id][s.start : s.end] for s in x.found] for x in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(18)] == [[c] for c in long_ + short]  # short ones are no seeds: their context gives them away
    assert not any(found[i] for i in found if i >= 100)


def test_the_graph_decides(spark):
    """Planted identifiers: form alone (rounds=0) reports none, the graph reports those in shared contexts, with or without the form, and no others."""
    r = random.Random(23)
    code = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "7c"
    prose = lambda n: " ".join(r.choice(["river", "stone", "in", "the", "over"]) for _ in range(n))
    planted = {i: code(40 if i < 14 else 9) for i in range(20)}
    alone = {100 + i: code(40) for i in range(5)}  # each in a context of its own
    rows = [(i, f"{prose(5)} apikey: {c} {prose(4)}") for i, c in planted.items()] + [(i, f"{prose(3)} q{chr(97 + i % 26)}z{chr(97 + i // 5 % 26)} {c} {chr(98 + i % 20)}y end") for i, c in alone.items()]
    rows += [(200 + i, f"{prose(3)} room 4{chr(97 + i % 20)}{i} {prose(4)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {n: {x.doc_id: [dict(rows)[x.doc_id][s.start : s.end] for s in x.found] for x in pii.extract(df, rounds=n).collect()} for n in (0, 3)}
    assert not any(found[0].values())
    told = {i for i, f in found[3].items() if f}
    assert told == set(planted) and all(found[3][i] == [c] for i, c in planted.items())  # precision and recall 1


def test_scores_of_the_graph(spark):
    r = random.Random(2)
    edges = sorted({(f"p{r.randrange(9)}", f"i{r.randrange(40)}") for _ in range(120)})
    seed = {i: r.choice([0.0, 0.0, 1.0]) for _, i in edges}
    score = dict(seed)
    for _ in range(3):
        of = defaultdict(list)
        for p, i in edges:
            of[p].append(score[i])
        confidence = {p: sum(x) / (len(x) + 1) for p, x in of.items() if len(x) >= 3 and sum(x) / (len(x) + 1) >= 0.4}
        reached = {i: 1 - np.prod([1 - confidence[p] for p, o in edges if o == i and p in confidence]) for i in seed}
        score = {i: max(seed[i], reached[i]) for i in seed}
    df = spark.createDataFrame([(p, i, seed[i]) for p, i in edges], "pattern string, instance string, seed double")
    got = pii.scored(df, 3, 0.4, 3).collect()
    assert {x.instance: x.score for x in got} == pytest.approx(score) and {x.instance: x.reached for x in got} == pytest.approx(reached)
    assert {x.instance: (x.score, x.reached) for x in pii.scored(df, 0, 0.4, 3).collect()} == {i: (x, 0.0) for i, x in seed.items()}


def test_overlaps(spark):
    r = random.Random(6)
    rows = []
    for n in range(60):
        cuts = sorted(r.sample(range(900), 2 * r.choice([0, 1, 3, 150])))
        cand = list(zip(cuts[::2], cuts[1::2]))
        fixed = [(a, a + r.randrange(1, 9)) for a in r.sample(range(900), r.choice([0, 1, 140]))]
        rows.append((n, fixed, cand))
    df = spark.createDataFrame(rows, "n long, f array<struct<start:int,end:int>>, c array<struct<start:int,end:int>>")
    for x in df.select("n", pii.overlapping(F.col("f"), F.col("c")).alias("o")).collect():
        assert x.o == [any(a < z2 and a2 < z for a2, z2 in rows[x.n][1]) for a, z in rows[x.n][2]]


def test_a_long_text_of_many_candidates(spark):
    """1 MB with some 40,000 candidates and 20,000 fixed spans: linear, so a few seconds."""
    line = "call +1 (555) 123-4567 or mail a.b@c.de on 12 may for item x{} in all twelve words\n"
    text = "".join(line.format(i) for i in range(12_000))
    assert len(text) > 900_000
    began = time.monotonic()
    x = pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(x.phone) == len(x.email) == 12_000 and time.monotonic() - began < 90


def test_sums_before(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        values = [i % 7 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        assert df.select(pii.sums_before(F.col("v")).alias("x")).first().x == [sum(values[:i]) for i in range(n)]


def test_line_rules(docs, rows):
    answer = {}
    for u in units(rows):
        w = re.findall(SPACE, u[2])
        c = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        m = [False] * len(w)
        for p in range(len(w) - 2):
            if c[tuple(w[p : p + 3])] > 1:
                m[p : p + 3] = [True] * 3
        lines = [x for x in u[2].split("\n") if re.search(SPACE, x)]
        failed = len(w) < 50 or 100 * sum(m) > 50 * len(w)
        answer[u] = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in u[2]), len(lines) - len(set(lines)), sum(m), failed)
    found = line_quality(docs).collect()
    assert by_row(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected(rows, answer)
    assert all(not r.kept for r in found if r.base_failed)


def test_common_lines_deplete(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    menu = [prose(30) for _ in range(3)]
    rows = [(i, "\n".join([*menu, prose(10)]), "h") for i in range(30)] + [(100 + i, prose(80), "h") for i in range(30)] + [(200 + i, "\n".join([*menu, "same"]), "other") for i in range(30)]
    rows += [(300 + i, "\n".join([menu[0].upper() + " ", prose(60), prose(7)]), "h") for i in range(5)] + [(i, "\n".join([*menu, prose(60)]), None) for i in range(400, 415)]
    rows += [rows[0], rows[95]]
    rows = [(*x, 7, "k") for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int, common string")
    normal = lambda x: " ".join(x.lower().split())
    hosts, held = defaultdict(set), defaultdict(set)
    for i, t, h, *_ in rows:
        hosts[h].add((i, t))
        for x in set(map(normal, t.split("\n"))) - {""}:
            held[h, x].add((i, t))
    common = {k for k, v in held.items() if len(v) > 20 and len(v) > 0.02 * len(hosts[k[0]])}
    rest = {(i, t): [x for x in t.split("\n") if (h, normal(x)) not in common] for i, t, h, *_ in rows}
    want = {}
    for (i, t), lines in rest.items():
        n, left = len(t.split()), len(" ".join(lines).split())
        c = Counter(zip(t.split(), t.split()[1:], t.split()[2:], strict=False))
        assert max(c.values()) == 1
        want[i, t] = n >= 50 and left >= 50 and left >= 0.3 * n
    got = line_quality(docs).collect()
    assert sorted((x.doc_id, x.kept) for x in got) == sorted((r[0], want[r[0], r[1]]) for r in rows)
    assert sum(not x.kept for x in got) == 61 and len(common) == 7
    clean = cleaned(docs)
    assert clean.columns == docs.columns
    assert sorted((x.doc_id, x.text, x.kept) for x in clean.collect()) == sorted((r[0], "\n".join(rest[r[0], r[1]]), 7) for r in rows if want[r[0], r[1]])


def shingles(t, k=3):
    w = re.findall(SPACE, re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent=90):
    nodes = sorted(set(sets), key=lambda s: sorted(s))
    parent = {s: s for s in nodes}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in itertools.combinations([s for s in nodes if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            parent[find(a)] = find(b)
    return {s: find(s) for s in nodes}


@pytest.mark.parametrize(("block", "strong", "k", "percent"), [(256, 3, 3, 90), (3, 2, 3, 90), (3, 99, 5, 80), (256, 2, 1, 50)])
def test_jaccard(spark, docs, rows, block, strong, k, percent, monkeypatch):
    monkeypatch.setattr("glyphmill.llm.jaccard.BLOCK", block)
    monkeypatch.setattr("glyphmill.llm.jaccard.LIST_BLOCK", block)
    monkeypatch.setattr("glyphmill.llm.jaccard.STRONG", strong)
    shingles = lambda t, k=k: globals()["shingles"](t, k)
    r = random.Random(9)
    base = [f"b{i}" for i in range(260)]
    more = []
    for i in range(90):
        w = base[: r.choice([3, 11, 12, 13, 21, 22, 23, 30, 33, 60, 200, 250])]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            p = r.randrange(len(w))
            w = w[:p] + r.choice([[], [f"z{r.randrange(3)}"]]) + w[p + r.randrange(2) :]
        more.append((1000 + i, " ".join(w)))
    df = docs.select("doc_id", "text", "tag", "sig").unionByName(spark.createDataFrame([(*m, 1, "") for m in more], "doc_id long, text string, tag long, sig string"))
    texts = [(x[0], x[1]) for x in rows] + more
    root = brute_components([shingles(t) for _, t in texts], percent)
    least = {}
    for i, t in texts:
        node = root[shingles(t)]
        least[node] = i if node not in least or least[node] is None or (i is not None and i < least[node]) else least[node]
    want = sorted(repr((i, len(shingles(t)), least[root[shingles(t)]] if shingles(t) else i)) for i, t in texts)
    assert sorted(repr((x.doc_id, x.n_shingles, x.component_id)) for x in jaccard_components(df, k, percent).collect()) == want
    kept = keep_one(df, k, percent).collect()
    assert len([x for x in kept if shingles(x.text)]) == len({root[shingles(t)] for _, t in texts if shingles(t)}) and len({root[shingles(x.text)] for x in kept if shingles(x.text)}) == len([x for x in kept if shingles(x.text)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1 and got[0] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment(spark, docs, rows):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    long_ = [r[1] for r in rows if r[1] and len(r[1].split()) >= 90]
    items = [(i, " ".join(t.split()[20 : 20 + n])) for i, (t, n) in enumerate(zip(long_ * 2, [6, 10, 14, 25, 40, 60, 8, 30] * 9, strict=False))]
    items += [(900, "A, B"), (901, ""), (902, None), (903, "no such words here at all")] + [items[0]]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id long")
    got = sorted(repr((r.doc_id, x.item_id, x.n_shared, x.n_shingles)) for r in with_leaks(docs, bench).collect() for x in r.leaks)
    want = []
    for r in rows:
        w = words(r[1])
        for i, t in items:
            v = words(t)
            k = min(5, len(v))
            own = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
            n = len(own & {tuple(w[p : p + k]) for p in range(len(w) - k + 1)})
            if own and n >= 0.8 * len(own):
                want.append(repr((r[0], i, n, len(own))))
    assert got == sorted(want) and len(want) > 50
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and 0 < clean.count() < len(rows) and {r.leaks for r in clean.collect()} == {"l"}
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_targets_of_billions_of_words(spark):
    """Level times weight passes 32 bits from 716 million words on; the level itself only from 2,147 million on."""
    for total in (800_000_000, 2_000_000_000, 4_000_000_000):
        sizes = [("a", total // 2), ("b", total // 2 - 1000), ("c", 1000)]
        found = {r.source: r.target for r in with_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
        assert found == pytest.approx({"a": (total - 3000) / 3, "b": (total - 3000) * 2 / 3, "c": 3000})


def test_cube(spark, docs, rows):
    def targets(sizes):
        found = with_targets(spark.createDataFrame([(f"s{i:03}", n) for i, n in enumerate(sizes)], "source string, size long"))
        return [r.target for r in found.orderBy("source").collect()]

    def filled(sizes):
        """By bisection: the level at which shares, cut at three times each size, add up to all sizes."""
        low, high = 0.0, 3.0 * sum(sizes) + 1
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(mid * (1 + i % 3), 3 * n) for i, n in enumerate(sizes)) < sum(sizes) else (low, mid)
        return [min(high * (1 + i % 3), 3 * n) for i, n in enumerate(sizes)]

    r = random.Random(6)
    for sizes in ([10, 0, 10], [1, 100, 100], [0], [7], [5, 0, 0, 900, 1, 1, 40], [r.choice([1, 50, 3000]) for _ in range(40)]):
        assert targets(sizes) == pytest.approx(filled(sizes), abs=1e-6)
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 100, 500)
    x = flight(p, size, np.random.default_rng(1))
    assert ((x > 1e-9) & (x < 1 - 1e-9)).sum() <= 2 and x.sum() == pytest.approx(p.sum()) and (x * size).sum() == pytest.approx((p * size).sum())
    for seed in range(20):  # sizes of real text: a few documents are hundreds of times as long as most
        sizes = np.maximum(np.random.default_rng(seed).lognormal(5, 1.3, 120).astype(int), 1)
        wanted = np.full(120, 0.37)
        taken = landing(flight(wanted, sizes, np.random.default_rng(seed + 99)), sizes, wanted)
        assert set(taken) <= {0.0, 1.0} and abs((taken * sizes).sum() - 0.37 * sizes.sum()) <= 2 and abs(taken.sum() - 0.37 * 120) <= 2
    for seed in range(60):  # few documents: as near as any choice comes, or nearer by copies
        g = np.random.default_rng(seed)
        n = int(g.integers(3, 13))
        sizes, wanted, whole = np.maximum(g.lognormal(5, 1.3, n).astype(int), 1), np.full(n, g.random() * 0.98 + 0.01), np.full(n, float(g.integers(0, 3)))
        taken = landing(flight(wanted, sizes, g), sizes, wanted, whole)
        miss = min(abs(sum(sizes[i] for i in range(n) if m >> i & 1) - (wanted * sizes).sum()) for m in range(1 << n))
        assert abs((taken * sizes).sum() - (wanted * sizes).sum()) <= miss + 0.5 and all(0 <= x <= 3 and x == round(x) for x in taken + whole)
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9).cast("int") + 1), " ").alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    for r in mix_sources(many).groupBy("target").agg(F.sum("taken").alias("n"), F.max(F.col("taken") / F.col("size")).alias("x")).collect():
        assert abs(r.n - r.target) <= 1 and r.x <= 3
    found = mix_sources(docs).collect()
    assert len(found) == len(rows) and sorted(map(repr, found)) == sorted(map(repr, mix_sources(docs.repartition(2)).collect()))
    mixed = take(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)


def test_classifier(spark):
    r = random.Random(2)
    good_ = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "river", "stone"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "click|", "win***", "NOW!!"]) for _ in range(60))
    rows = [(i, good_() if i % 3 else bad(), 0.5) for i in range(400)] + [(None, "x", 0.1), (5000, None, 0.1), (5001, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (9999, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    found = classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found)
    held = [x for x in found if x.doc_id is not None and x.doc_id < 400 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in held) / len(held) > 0.97
    none = classify(docs, labels.limit(0)).collect()
    assert len({x.score for x in none}) == 1 and none[0].predicted == 1


def test_encode_column_equals_the_tokenizer(spark):
    pytest.importorskip("tokenizers")
    import pyarrow as pa

    enc = rans.encoder(rans.tokenizer_path(spark))
    texts = ["", None, " ", "  a", "a  b", "a\n b", "don't 's x", "é ñ dogs'.", " lead", "trail ", "a\nb", "a\n\nb", "a\r\nb, c.\nIs $$$", f"a {enc.special[0]} b", "a " * 50]
    assert enc.encode_column(pa.array(texts)) == [enc.direct(t or "") for t in texts]
    assert enc.encode_column(pa.array([], pa.string())) == []


@pytest.mark.parametrize("operator", [debruijn_dedup, suffix.suffix_dedup, pii.extract, line_quality, jaccard_components, keep_one, mix_sources, take, lambda d: rans.read_blocks(*rans.write_blocks(d, rans.tokenizer_path(d.sparkSession)))])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    lexicon = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(lexicon) for _ in range(n))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "win***"]) for _ in range(80))
    item = prose(30)
    texts = [prose(120) for _ in range(60)] + [bad() for _ in range(30)]
    texts += [texts[0], " ".join(texts[1].split()[:-2]), prose(50) + " " + item + " " + prose(50)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(x.doc_id for x in out)
    assert set(ids) <= set(range(60)) and len(ids) > 30 and max(ids.values()) <= 3
    assert sorted(x.start for x in out)[0] == 0 and all(x.n_tokens > 100 for x in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert hashlib.sha256(repr(sorted(out)).encode()).hexdigest() == hashlib.sha256(repr(sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())).encode()).hexdigest()


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    r = random.Random(21)
    base = [[f"n{r.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    edited = list(base[2])
    for p in (30, 80, 120, 170):
        edited[p] = "other"
    texts = base + [base[0][:-35], base[1][:-25], edited, base[3][:-45]]
    five = lambda w: {tuple(w[p : p + 5]) for p in range(len(w) - 4)}
    share = [len(five(a) & five(b)) / len(five(a) | five(b)) for a, b in zip(base, texts[4:], strict=True)]
    assert 0.82 < share[0] < 0.83 and 0.8 < share[1] < 0.9 and 0.8 < share[2] < 0.9 and share[3] < 0.8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()) == [0, 1, 2, 3, 7]


def test_a_worker_keeps_one_operators_things(spark):
    enc = rans.encoder(rans.tokenizer_path(spark))
    assert rans.encoder(rans.tokenizer_path(spark)) is enc
    index = containment.index_of("a", [1], ["one two three four five six"], 5, 0.8)
    assert containment.index_of("a", [], [], 5, 0.8) is index and list(common._KEPT.values()) == [index]
    blocks = jaccard.by_blocks(["i", "j"], "b", lambda group, left: [], [("a", pa.int64())])
    assert list(blocks(iter([]))) == [] and not common._KEPT


def test_few_texts_but_members_are_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "x"), (7, None)], "doc_id long, text string")
    docs = jaccard.tagged(rows)
    parts = docs.where("doc_id % 100 = 0 OR doc_id IS NULL OR text IS NULL").selectExpr("doc_id AS _id", "tag AS _tag")
    want = {tuple(r) for r in parts.collect()}
    got = jaccard.only_members(docs, parts).collect()
    assert {(r.doc_id, r.tag) for r in got} >= want and len(want) == 22 and len(got) < 400
    monkeypatch.setattr(jaccard, "MOST_BITS", 64)  # full
    assert {(r.doc_id, r.tag) for r in jaccard.only_members(docs, parts).collect()} >= want


def test_free_memory_is_given_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "let_go", lambda: calls.append(len(out)))
    out = []
    for batch in common.lean(lambda batches: batches)(iter([pa.record_batch({"x": [i]}) for i in range(3)])):
        out.append(batch)
    assert [b.column("x")[0].as_py() for b in out] == [0, 1, 2] and calls == [1, 2, 3, 3]


def test_stages_send_small_batches_when_another_writes_them(spark):
    import corpus_pipeline

    before = spark.conf.get(common.BATCH)
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            spark.conf.set(common.BATCH, "64MB")
            rows = spark.createDataFrame([(i, f"{i} " * 60000) for i in range(40)], "doc_id long, text string").coalesce(1)
            stage(spark, rows, "/root/testdata/sf0.001")
            sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()
            assert len(sizes) > 1 and max(r.n for r in sizes) < 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH, "1000")
        common.keep_small_batches(spark)
        assert spark.conf.get(common.BATCH) == "1000"
    finally:
        spark.conf.set(common.BATCH, before)


def test_containment_of_few_shingles(spark):
    r = random.Random(12)
    prose = lambda n: [f"q{r.randrange(10**5)}" for _ in range(n)]
    items = [prose(5 + i % 11) for i in range(1100)]
    rows = [(i, " ".join(prose(300) + w + prose(300))) for i, w in enumerate(items)]
    cut = [(2000 + i, " ".join(prose(40) + w[:-1] + prose(40))) for i, w in enumerate(items)]  # one shingle missing: a leak from five on
    docs = spark.createDataFrame(rows + cut, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = sorted((x.doc_id, y.item_id, y.n_shared, y.n_shingles) for x in with_leaks(docs, bench).collect() for y in x.leaks)
    want = [(i, i, len(w) - 4, len(w) - 4) for i, w in enumerate(items)]
    want += [(2000 + i, i, len(w) - 5, len(w) - 4) for i, w in enumerate(items) if len(w) >= 9]
    assert got == sorted(want)


def test_anchors_in_pieces(monkeypatch):
    r = np.random.default_rng(5)
    values = r.integers(0, 1 << 64, 40, dtype=np.uint64)[r.integers(0, 40, 5000)]
    values[1000:1400] = values[0]
    for window, k, offsets in ((20, 6, [0, 5000]), (200, 32, [0, 5000]), (20, 6, [0, 7, 7, 2600, 5000])):
        whole = winnow.anchors(values, np.array(offsets), window, k)
        for piece in (window, 211, 1024, 4999):
            monkeypatch.setattr(winnow, "PIECE", piece)
            found = winnow.anchors(values, np.array(offsets), window, k)
            assert all(np.array_equal(getattr(whole, f), getattr(found, f)) for f in ("doc", "place", "left", "right", "key", "around", "chosen"))
        monkeypatch.undo()


def test_anchors_beyond_the_places_of_a_piece():
    n = (1 << 24) + 5000
    values = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values[-3000:] = values[:3000]  # the end repeats the beginning
    found = winnow.anchors(values, np.array([0, n]), 200, 32)
    head, tail = found.chosen[: 3000 - 199], found.chosen[n - 3000 : n - 199]
    assert np.array_equal(head, tail - (n - 3000)) and found.place.max() >= n - 3000
