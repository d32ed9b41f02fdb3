"""Sharding, phrases and the prefix trie against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import phrases, queries, scan, shards, trie

DOCS = "doc_id long, text string, lang string, source string, size string, shard string, part string, grp string, place string, slot string, doc string, phrase string"


def documents():
    r = random.Random(12)
    lexicon = [f"w{i}" for i in range(30)] + ["Été", "語", "A", "b c"]
    ends = [". ", ", ", "!?", "\n", " ", " ", " ", " ", "\t "]
    texts = ["".join(r.choice(lexicon) + r.choice(ends) for _ in range(r.choice([1, 8, 60, 300]))) for _ in range(60)]
    texts += [texts[3]] * 40 + [None, None, "", "", " \t", "...", "a", "x" * 5000, "one two three. " * 300, "ab " * 20_000]
    rows = [(i, t, [None, "en", "und", "de"][i % 4], "s", *"abcdefgh") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[7], *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def scheduled(units, n):
    load = [0] * n
    out = []
    for size, key, whole in sorted(units, key=lambda u: (-u[0], u[2], u[1])):
        s = min(range(n), key=lambda i: (load[i], i))
        load[s] += size
        out.append(((size, key, whole), s))
    return dict(out), load


@pytest.mark.parametrize("n, units, bundles", [(24, 1000, 250), (5, 3, 4), (1, 2, 1)])
def test_shards(spark, docs, rows, n, units, bundles, tmp_path):
    path = shards.write_shards(docs, n, str(tmp_path / "s"), units, bundles)
    got = shards.read_shards(spark, path).collect()
    text = lambda r: r[1] or ""
    assert sorted(map(repr, (tuple(r.doc) for r in got))) == sorted(map(repr, rows))
    assert all(r["size"] == len((r.doc.text or "").encode()) + 8 for r in got)
    of = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        of[r.doc.text or ""].add(r.shard)
        slots[r.shard].append((r.slot, r.doc.doc_id))
    assert all(len(s) == 1 and 0 <= min(s) < n for s in of.values())
    for s in slots.values():
        assert [x[0] for x in sorted(s)] == list(range(len(s)))
        ids = [x[1] if x[1] is not None else -1 for x in sorted(s)]
        assert ids == sorted(ids)
    # the same schedule by a search for the least loaded shard
    hashes = {r.t: (r.g, r.b) for r in spark.createDataFrame([(t,) for t in {text(r) for r in rows}], "t string").select("t", shards.group_of("t").alias("grp")).select("t", F.col("grp").alias("g"), shards.bundle_of(n * bundles).alias("b")).collect()}
    size = Counter()
    for r in rows:
        size[hashes[text(r)]] += len(text(r).encode()) + 8
    total = sum(size.values())
    whole = {k: s * n * units >= total for k, s in size.items()}
    merged = Counter()
    for (g, b), s in size.items():
        merged[(g if whole[g, b] else b, whole[g, b])] += s
    assert len(merged) <= n * (units + bundles)
    want, load = scheduled([(s, k, w) for (k, w), s in merged.items()], n)
    where = {(k, w): s for (_, k, w), s in want.items()}
    assert all(of[t] == {where[g if whole[g, b] else b, whole[g, b]]} for t, (g, b) in hashes.items())
    assert max(load) - min(load) <= max(merged.values())


def test_schedule_by_heap():
    r = random.Random(3)
    for n in (1, 3, 24):
        units = [(r.choice([1, 5, 5, 70, r.randrange(1, 999)]), k, r.random() < 0.5) for k in range(200)]
        want, _ = scheduled(units, n)
        assert dict(zip(units, shards.longest_first(units, n))) == want


def test_shards_are_even_where_a_text_is_a_third_of_all(spark, tmp_path):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text again").otherwise(F.concat(F.lit("text "), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")), "id")).alias("text"))
    got = shards.read_shards(spark, shards.write_shards(df, 8, str(tmp_path / "s"))).groupBy("shard").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), (F.max("slot") + 1).alias("slots")).collect()
    assert sum(r.rows for r in got) == 6000 and all(r.rows == r.slots for r in got)
    load = sorted(r.n for r in got)
    assert load[-2] - load[0] <= 80  # the largest has the group, which is more than a shard's mean
    assert spark.read.parquet(str(tmp_path / "s/manifest")).count() > 8  # a shard is many tasks' work
    empty = shards.read_shards(spark, shards.write_shards(df.limit(0), 8, str(tmp_path / "e")))
    assert empty.count() == 0 and {"doc", "size", "shard", "slot"} <= set(empty.columns)


def test_query_op11(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_shards(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((repr(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def brute_runs(rows):
    lower = str.maketrans(phrases.UPPER, phrases.LOWER)
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (r[1] or "").translate(lower)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return f, n


def brute_scores(f, least):
    out = {}
    for (lang, ws), a in f.items():
        if len(ws) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, ws[:c]] + f[lang, ws[c:]]), c) for c in range(1, len(ws))]
        score, c = min(cuts)
        out[lang, ws] = (a, f[lang, ws[:c]], f[lang, ws[c:]], score)
    return out


def brute_phrases(rows, least, top):
    f, n = brute_runs(rows)
    found = brute_scores(f, least)
    inside = lambda x, y: len(x) < len(y) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    kept = {k: v for k, v in found.items() if not any(k[0] == o[0] and inside(k[1], o[1]) and 100 * w[0] >= 80 * v[0] for o, w in found.items())}
    out = []
    for lang in {k[0] for k in kept}:
        mine = sorted(((-v[3], -v[0], " ".join(ws).encode(), v) for (g, ws), v in kept.items() if g == lang))[:top]
        out += [(lang, i + 1, p.decode(), *v[:3], n[lang], v[3]) for i, (_, _, p, v) in enumerate(mine)]
    return out


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 7)])
def test_phrases(docs, rows, least, top):
    want = brute_phrases(rows, least, top)
    assert len(want) > 20
    assert sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == sorted(want)
    tight = phrases.Limits(slice=2000, chunk=17, memory="24MB", bits=8)  # nearly every pair has its bit set
    assert sorted(map(tuple, phrases.collocations(docs.repartition(7), least, top, tight).collect())) == sorted(want)


def test_query_op12(spark, rows, tmp_path):
    spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_collocations(spark, str(tmp_path)).collect()))
    assert got == sorted(brute_phrases(rows, 30, 2000)) and got


def test_phrases_of_little(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "a b", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    assert [tuple(r) for r in phrases.collocations(df, least=1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    r = random.Random(5)
    f = {("en", ("a",)): 9 * 10**17, ("en", ("b",)): 7 * 10**17 + 1, ("en", ("c",)): 10**17 + 3}
    f |= {("en", k): r.randrange(10**13, 10**17) for k in [("a", "b"), ("b", "c"), ("a", "b", "c"), ("c", "a")]}
    runs = spark.createDataFrame([(lang, " ".join(ws), len(ws), n) for (lang, ws), n in f.items()], "lang string, phrase string, k int, f long")
    want = brute_scores(f, 30)
    assert {(x.lang, tuple(x.phrase.split())): (x.a, x.l, x.r, x.score) for x in phrases.scored(runs).collect()} == want


def brute_trie(convs):
    """Nodes of conversations {id: [(role, text)]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], sha(n)) for n, m in members.items())


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def shown(found):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in found)


def conversations():
    r = random.Random(2)
    say = lambda: r.choice(["hi", "é語", "", None, "tell me more", "no"])
    rows = []
    for c in range(60):
        start = r.randrange(4)
        for i in range(r.choice([0, 1, 2, 5, 12])):
            text = f"opening {start}" if i < 2 and start < 3 else say()
            rows.append((c * 3, i if r.random() < 0.9 else None, r.choice(["user", "assistant", None]) if i else "user", text))
    rows += [(1000 + c, i, "user", f"same {i}") for c in range(30) for i in range(4)]  # copies
    rows += [(2000, i, "user", f"long {i // 3}") for i in range(700)] + [(2001, i, "user", f"long {i // 3}") for i in range(500)]
    rows += [(2002, None, "user", "no turn"), (2002, None, None, None), (2003, 1, "a", "x"), (2003, 1, "a", "x"), (2003, 1, "a", "y"), (2004, 0, "user", "z" * 100_000), (None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(*x, "path", 5, "more") for x in conversations()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, depth int, light string").repartition(5).cache()


def test_trie(spark, talks):
    convs = ordered(conversations())
    found = trie.prefix_trie(talks).collect()
    assert shown(found) == brute_trie(convs)
    # heavy paths: one node for each depth, and of the children of a node at most one goes on with its path
    paths = defaultdict(list)
    for x in found:
        paths[x.path].append(x.depth)
    assert all(sorted(d) == list(range(min(d), max(d) + 1)) for d in paths.values())


def test_query_op13(spark, talks, tmp_path):
    talks.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    assert shown(queries.op13_prefix_trie(spark, str(tmp_path)).collect()) == brute_trie(rebuilt(ordered(conversations())))


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(4, 0, "user", "x")], [(c, 0, "user", "x") for c in range(3)], [(c, i, "user", "x" * (i + c % 2)) for c in range(64) for i in range(c % 7)]])
def test_tries_of_little(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = ordered(rows)
    assert shown(trie.prefix_trie(df).collect()) == brute_trie(convs)
    members = trie.conv_ids(df)
    assert shown(trie.trie(trie.regrouped(trie.placed(df), members), members).collect()) == brute_trie(rebuilt(convs))


def test_conversations_without_turns(spark):
    members = spark.createDataFrame([(3,), (1,), (2,)], "conv_id long")
    none = spark.createDataFrame([], "conv_id long, pos long, t1 long, t2 long, bytes long")
    assert shown(trie.trie(none, members).collect()) == brute_trie({1: [], 2: [], 3: []})


@pytest.mark.parametrize("kind", ["sum", "xor"])
def test_running_totals_over_tasks(spark, kind):
    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, 2, 3, 9]), i, r.randrange(1 << 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(9)
    got = {x.i: x.run_v for x in scan.running(scan.dealt(df, [F.col("g"), F.desc("i")]), "g", {"v": kind}).collect()}
    at = Counter()
    for g, i, v in sorted(rows, key=lambda x: (x[0], -x[1])):
        at[g] = at[g] + v if kind == "sum" else at[g] ^ v
        assert got[i] == at[g]
    empty = scan.running(scan.dealt(df.limit(0), [F.col("g"), F.col("i")]), "g", {"v": kind})
    assert empty.count() == 0
