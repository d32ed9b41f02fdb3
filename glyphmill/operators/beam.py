"""Beam search over lattices with a table of scores: joins and windows score the steps, a lattice is searched where it is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START = -1


def step_scores(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """key, position, prev, id, lp: log probabilities among the allowed ids of each position only.

    ``scores``: prev, id, score (from ``START`` at the first position); ``allowed``: key, position, id.  An id without a score
    after ``prev`` cannot follow it.  Rows are dealt by key, which is all that a search needs.
    """
    rows = allowed.join(scores, "id").repartition("key")
    before = Window.partitionBy("key", "position", "prev")
    top = F.max("score").over(before)
    return rows.select("key", "position", "prev", "id", (F.col("score") - top - F.log(F.sum(F.exp(F.col("score") - top)).over(before))).alias("lp"))


def best_paths(steps: dict[tuple[int, int], list[tuple[float, int]]], length: int, width: int, classes: int | None) -> list[tuple[float, list[int]]]:
    """The best paths of one lattice; ``steps``: for each (position, prev) its (score, id), the best first."""
    beams: list[tuple[float, list[int]]] = [(0.0, [])]
    for position in range(length):
        grown = []
        for rank, (score, ids) in enumerate(beams):
            own = [(lp, i) for lp, i in steps.get((position, ids[-1] if ids else START), []) if lp > float("-inf")][:width]
            if classes is not None and len(own) < width:
                taken = {i for _, i in own}
                own += [(float("-inf"), i) for i in range(min(classes, width + len(taken))) if i not in taken][: width - len(own)]
            grown += [(-round(score + lp, 9), rank, i, score + lp) for lp, i in own]
        grown.sort()
        beams = [(score, [*beams[rank][1], i]) for _, rank, i, score in grown[:width]]
    return beams


def beam_search(steps: DataFrame, length: int, width: int = 3, classes: int | None = None) -> DataFrame:
    """key, rank, ids, score: the best paths through ``step_scores`` of samples of ``length`` positions.

    Of each path its ``width`` best next ids, then of each sample its ``width`` best sums; scores are not divided by the
    length; scores that agree to nine decimals are ties and go to the better parent, then the lower id.  With ``classes``, the
    number of ids, there are always ``width`` paths: those that cannot be have a score of minus infinity and go on with
    the lowest ids; ``width`` must not be more than ``classes``.  A lattice is gathered once, whatever its length.
    """
    if classes is not None and width > classes:
        raise ValueError(f"{width} paths of {classes} classes")
    kind = dict(steps.dtypes)["key"]
    rows = steps.where(F.col("position") < length).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("position", "prev", (-F.round("lp", 9)).alias("order"), "id", "lp"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat = batch.column(1).flatten()
            position, prev, ids, lp = (flat.field(c).to_pylist() for c in ("position", "prev", "id", "lp"))
            at = batch.column(1).offsets.to_pylist()
            for r, key in enumerate(batch.column(0).to_pylist()):
                steps: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for i in range(at[r] - at[0], at[r + 1] - at[0]):
                    steps.setdefault((position[i], prev[i]), []).append((lp[i], ids[i]))
                out += [(key, rank, path, score) for rank, (score, path) in enumerate(best_paths(steps, length, width, classes))]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.list_(pa.int32()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "rank", "ids", "score"])

    return rows.mapInArrow(run, f"key {kind}, rank int, ids array<int>, score double")


def candidates(steps: DataFrame, beams: DataFrame) -> DataFrame:
    """key, position, id, prob: what each position could be, by the best of the beams that lead there."""
    paths = beams.select("key", F.posexplode(F.concat(F.array(F.lit(START)), F.slice("ids", F.lit(1), F.size("ids") - 1))).alias("position", "prev")).distinct()
    return steps.join(paths, ["key", "position", "prev"]).groupBy("key", "position", "id").agg(F.exp(F.max("lp")).alias("prob"))


def predict(steps: DataFrame, length: int, top: int = 1, classes: int | None = None) -> dict[str, DataFrame]:
    """Greedy for ``top`` 1: ``best``.  Else ``nbest`` paths, and ``per_position``: the ``top`` likeliest ids of each position, in order."""
    beams = beam_search(steps, length, max(top, 1), classes)
    if top <= 1:
        return {"best": beams.select("key", "ids", "score")}
    ranked = F.sort_array(F.collect_list(F.struct(F.round(-F.col("prob"), 9).alias("p"), "id")))
    per = candidates(steps, beams).groupBy("key", "position").agg(F.slice(ranked, 1, top).alias("r"))
    return {"nbest": beams, "per_position": per.select("key", "position", F.transform("r", lambda x: x["id"]).alias("ids"), F.transform("r", lambda x: -x["p"]).alias("probs"))}
