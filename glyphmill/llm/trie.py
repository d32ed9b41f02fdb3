"""The trie of all prefixes of conversations, with what each subtree holds, by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .scan import dealt, running

NODE = ["depth", "x1", "x2"]
TURN = ["t1", "t2", "bytes"]


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), and of each turn the 128-bit hash (t1, t2) of role and text and the bytes of its text.

    Turns are in the order of ``turn`` (null first), equal ones in that of the first 32 characters of role and text,
    then of both whole.  Null role and text are empty; rows without conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 32), F.substring("text", 1, 32)]
    ordered = dealt(rows, keys, [F.col("role"), F.col("text")])
    hashes = [F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes")]
    counted = running(ordered.select("conv_id", *hashes, F.lit(1).cast("long").alias("one"), "_part"), "conv_id", {"one": "sum"})
    return counted.select("conv_id", (F.col("run_one") - 1).alias("pos"), *TURN)


def conv_ids(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


def regrouped(turns: DataFrame, members: DataFrame, size: int = 5, most: int = 9) -> DataFrame:
    """``placed`` turns with the head of each conversation c replaced by that of the first of its block, c - c % size.

    The head has crc32(c as decimal text) % most turns, or all where there are fewer.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % most
    wanted = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % size).alias("of"), head.alias("h"))
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "of").join(wanted, "of").where(F.col("pos") < F.col("h")).select("conv_id", "pos", *TURN)
    found = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
    own = turns.withColumn("h", head).where("pos >= h").join(found, "conv_id", "left")
    return heads.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("m", F.lit(0))).alias("pos"), *TURN))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the conversations as they are."""
    return trie(placed(conversations), conv_ids(conversations))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of any conversation, from the empty one (depth 0).

    conv_id (smallest member), depth, parent_conv_id (smallest member of the parent; null for the root), n_convs
    (members), n_children, n_leaves (childless nodes below or here), saved_tokens (over all nodes below or here,
    (n_convs - 1) * bytes of the last text), ends_sha256 (of the members that end here, ascending decimal ids joined
    by commas), path (the heavy path's lowest member).  ``turns``: as ``placed`` gives them; ``members``: the
    conv_id of all conversations, turnless ones included.  A conversation of any length and a turn that any number
    of conversations share are spread over tasks.  No conversations, no nodes.
    """
    root = members.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    chains = chains_of(turns)
    nodes = save(tree(chains, root["c"]), free=False)
    rows, tops = paths(chains, nodes, root["c"], root["n"])
    attached = lifted(tops)
    joined = rows.join(attached, ["path", "depth"], "left")
    for c in ("leaves", "saved"):
        joined = joined.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).drop(f"more_{c}")
    summed = running(dealt(joined, [F.col("path"), F.desc("depth")]), "path", {"leaves": "sum", "saved": "sum"})
    last = members.join(chains.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")), "conv_id", "left")
    last = last.select("conv_id", *[F.coalesce(f"end.{c}", F.lit(0).cast("long")).alias(c) for c in NODE])
    out = summed.join(digests(last), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256"), "path")


def chains_of(turns: DataFrame) -> DataFrame:
    """conv_id, depth, the 128-bit key (x1, x2) of the first depth turns and that of one turn less (p1, p2), bytes.

    A key is the exclusive or of hashes of (place, turn), so those of all prefixes are running totals.
    """
    place = turns.select("conv_id", "pos", "bytes", F.xxhash64("pos", "t1", "t2").alias("z1"), F.xxhash64("t2", "pos", F.lit(3), "t1").alias("z2"))
    out = running(dealt(place, [F.col("conv_id"), F.col("pos")]), "conv_id", {"z1": "xor", "z2": "xor"})
    keys = [F.col("run_z1").alias("x1"), F.col("run_z2").alias("x2"), F.col("run_z1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("run_z2").bitwiseXOR(F.col("z2")).alias("p2")]
    return out.select("conv_id", (F.col("pos") + 1).alias("depth"), *keys, "bytes")


def tree(chains: DataFrame, root: int | None) -> DataFrame:
    """Nodes below the root: key, node (smallest member), n_convs, bytes, n_children, parent_conv_id, and whether a node is its parent's largest child (most members, then smallest id)."""
    grouped = chains.groupBy(*NODE).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max(F.struct("p1", "p2")).alias("p"))
    nodes = save(grouped.select(*NODE, "node", "n_convs", "bytes", "p.p1", "p.p2"), free=False)
    best = F.max(F.struct("n_convs", (-F.col("node")).alias("minus")))
    up = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"), (-best["minus"]).alias("largest"))
    top = up.where("depth = 0").select(*NODE, F.lit(root).cast("long").alias("node"), "largest")
    known = nodes.join(up, NODE, "left")
    above = known.select(*NODE, "node", "largest").where("largest IS NOT NULL").unionByName(top)
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("node").alias("parent_conv_id"), F.col("largest").alias("heavy"))
    known = known.withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("largest")
    return known.join(above, ["depth", "p1", "p2"]).withColumn("light", (F.col("node") != F.col("heavy")).cast("long")).drop("heavy", "p1", "p2")


def paths(chains: DataFrame, nodes: DataFrame, root: int | None, n: int) -> tuple[DataFrame, DataFrame]:
    """All nodes by heavy path, and one row for each path: how many light nodes are above it, and where it hangs.

    A path is known by the conversation that its lowest node ends.  From the end of that conversation up, the path's
    nodes are those to the first light one; each node is found on one path so.
    """
    ends = nodes.where("n_children = 0").select(F.col("node").alias("conv_id"))
    along = chains.select("conv_id", *NODE).join(ends, "conv_id", "left_semi").join(nodes, NODE)
    along = along.select(F.col("conv_id").alias("path"), *NODE, "node", "n_convs", "n_children", "parent_conv_id", "light", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    walked = running(dealt(along, [F.col("path"), F.desc("depth")]), "path", {"light": "sum"})
    levels = walked.groupBy("path").agg(F.sum("light").alias("level"))
    first = levels.where("level = 0").first()
    zero = F.lit(0).cast("long")
    own = nodes.sparkSession.range(1 if n else 0).select(F.lit(first["path"] if first else root).cast("long").alias("path"), *[zero.alias(c) for c in NODE], F.lit(root).cast("long").alias("node"), F.lit(n).cast("long").alias("n_convs"))
    below = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    own = own.crossJoin(F.broadcast(below)).select("*", F.lit(None).cast("long").alias("parent_conv_id"), zero.alias("light"), zero.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))  # one row each
    rows = save(walked.where("run_light - light = 0").drop("run_light").unionByName(own), free=False)
    hang = F.max(F.when(F.col("light") == 1, F.struct((F.col("depth") - 1).alias("depth"), "parent_conv_id"))).alias("top")
    tops = rows.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), hang).where("top IS NOT NULL").join(levels, "path")
    at = rows.select(F.col("path").alias("parent_path"), "depth", F.col("node").alias("parent_conv_id"))
    tops = tops.select("path", "leaves", "saved", "level", "top.depth", "top.parent_conv_id").join(at, ["depth", "parent_conv_id"])
    return rows, save(tops.drop("parent_conv_id"), free=False)


def lifted(tops: DataFrame) -> DataFrame:
    """path, depth, more_leaves, more_saved: what the light paths that hang there hold, with all that hangs below them.

    One round for each number of light nodes above a path, the largest first.  As a light node has at most half
    of its parent's members, there are at most log2(conversations) rounds.
    """
    deepest = tops.agg(F.max("level")).first()[0] or 0
    done: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        rows = tops.where(F.col("level") == level).drop("level")
        if done:
            below = done[-1].groupBy(F.col("parent_path").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            rows = rows.join(below, "path", "left").select("path", "parent_path", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        done.append(save(rows.select("path", "parent_path", "depth", "leaves", "saved"), free=False))
    out = tops.select("path", "parent_path", "depth", "leaves", "saved").limit(0)
    for rows in done:
        out = out.unionByName(rows)
    return out.groupBy(F.col("parent_path").alias("path"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def digests(rows: DataFrame) -> DataFrame:
    """For each node key of rows (key, conv_id), sha: hex SHA-256 of its ids, ascending, joined by commas.

    Ids are sorted and joined in pieces of a batch; the pieces of a node are hashed one after the other, so a task
    holds one of them at a time, however many conversations end at a node.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE])
            cut = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            texts = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), batch.column("conv_id").cast(pa.string()))
            first = pa.array(cut[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in NODE), batch.column("conv_id").take(first), pa.compute.binary_join(texts, ",")], [*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in NODE), batch.column("ids").to_pylist()):
                if key != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield rows_of(out)
        if at is not None:
            yield rows_of([(*at, state.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], [*NODE, "sha"])

    pieces = dealt(rows, [F.col(c) for c in (*NODE, "conv_id")]).select(*NODE, "conv_id").mapInArrow(joined, "depth long, x1 long, x2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, x1 long, x2 long, sha string")
