"""The queries of the training-data operators: each applies one to its whole table and derives what its contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, pii, shards, trie
from .common import table
from .containment import with_leaks
from .debruijn import debruijn_dedup
from .jaccard import jaccard_components
from .linefreq import line_quality
from .mixing import mix_sources
from .phrases import collocations
from .quality import classify, fold
from .rans import read_blocks, tokenizer_path, write_blocks
from .suffix import suffix_dedup


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(*write_blocks(table(spark, sf_dir, "documents"), tokenizer_path(spark)))


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_prefix_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    examples = chat.prefix_examples(rows.unionByName(own))
    turns = F.when(F.col("last"), chat.read_turns(F.col("text")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select("conv_id", "example", chat.loss_text().alias("loss"), F.length("text").alias("n"), turns.alias("turns"))
    read = read.select("conv_id", F.struct("example", "loss").alias("part"), "n", F.size("turns").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("sha"), F.col("turns").isNotNull().alias("last"))
    out = read.groupBy("conv_id").agg(F.max(F.when(F.col("last"), F.col("n_turns"))).cast("long").alias("n_turns"), F.max(F.when(F.col("last"), F.col("sha"))).alias("turns_sha256"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("content", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    kinds = {k: k for k in pii.PATTERNS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(pii.listed(kinds), 256).alias("base_sha256"), pii.listed(kinds | {"id": "found"}).alias("spans"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds."""
    leaks = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.n_shared", "x.n_shingles")


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.read_shards(spark, shards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))
    crc = F.crc32(F.coalesce("doc.text", F.lit("")))
    return rows.select("doc.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    members = trie.conv_ids(rows)
    return trie.trie(trie.regrouped(trie.placed(rows), members), members).drop("path")


QUERIES = {f.__name__: f for f in (op1_rans_tokens, op2_debruijn, op3_prefix_chat, op4_suffix, op5_pii, op6_line_quality, op7_quality, op8_jaccard, op9_containment, op10_cube_mix, op11_shards, op12_collocations, op13_prefix_trie)}

ORACLE: dict[str, str] = {
    "op2_debruijn": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS p, ws FROM w WHERE len(ws) >= 20
), keyed AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k FROM win
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE rn > 1
), gone_list AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), pos AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS text
  FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i WHERE gone.i IS NULL GROUP BY pos.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN gone_list USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_containment": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7F]+') AS ws FROM benchmark
), i AS (
  SELECT item_id, ws, least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0
), ish AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id
), dsh AS (
  SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, ks.k, unnest(range(1, len(ws) - ks.k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM i) ks WHERE len(ws) >= ks.k)
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles
FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)""",
    "op12_collocations": r"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang
), grams AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) ks WHERE len(ws) >= k
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2
), cuts AS (
  SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM c
), told AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')
), worst AS (
  SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank
  FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * w.a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_prepend(unicode(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS s
  FROM (SELECT DISTINCT conv_id FROM own)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(s, 4294967295) % 9 AS h FROM bits
), heads AS (
  SELECT c.conv_id, o.i, o.role, o.text FROM c JOIN own o ON o.conv_id = c.base AND o.i < c.h
), built AS (
  SELECT * FROM heads UNION ALL
  SELECT o.conv_id, o.i - c.h + (SELECT count(*) FROM heads WHERE heads.conv_id = o.conv_id), o.role, o.text FROM own o JOIN c USING (conv_id) WHERE o.i >= c.h
), lists AS (
  SELECT c.conv_id, coalesce(list([role, text] ORDER BY i) FILTER (i IS NOT NULL), []) AS turns FROM c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id
), chain AS (
  SELECT conv_id, d, len(turns) AS len, to_json(turns[1:d])::VARCHAR AS k, to_json(turns[1:d - 1])::VARCHAR AS up, CASE WHEN d > 0 THEN strlen(turns[d][2]) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM lists)
), node AS (
  SELECT k, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len), '')) AS ends_sha256 FROM chain GROUP BY k, d
), kids AS (
  SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT a.k, sum(n.saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM node n LEFT JOIN kids ON kids.k = n.k JOIN chain a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.k
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN node p ON p.k = n.up""",
}
