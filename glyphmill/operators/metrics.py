"""Evaluation: top-k accuracy, sentences, calibration, losses, all from arrays of logits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import let
from ..functions.profile import IGNORE


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def log_probability(x: Column, target: Column) -> Column:
    return F.get(x, target) - logsumexp(x)


def rank_of(x: Column, target: Column) -> Column:
    """How many classes come before the target; of equal logits the lower class comes first."""
    own = F.get(x, target)
    return F.size(F.filter(F.transform(x, lambda v, i: (v > own) | ((v == own) & (i < target))), lambda b: b))


def ranked(x: Column, k: int) -> Column:
    """The k best classes."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: p["i"])


def top_mass(x: Column, k: int | Column) -> Column:
    """Probability of the k best classes."""
    return let(logsumexp(x), lambda lse: F.aggregate(F.slice(F.sort_array(x, asc=False), F.lit(1), F.lit(k) if isinstance(k, int) else k), F.lit(0.0), lambda a, v: a + F.exp(v - lse)))


def accuracy(df: DataFrame, rank: str, by: list[str] | None = None) -> DataFrame:
    hits = [F.sum((F.col(rank) < k).cast("long")).alias(f"top{k}") for k in (1, 3, 5)]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("tokens"), *hits)


def sentence_accuracy(tokens: DataFrame, sentences: DataFrame, sentence: str, correct: str) -> DataFrame:
    """A sentence counts as correct if all its tokens are; one without tokens does."""
    per = tokens.groupBy(sentence).agg(F.bool_and(correct).alias("all_correct"))
    joined = sentences.select(sentence).distinct().join(per, sentence, "left").select(F.coalesce("all_correct", F.lit(True)).alias("ok"))
    return joined.agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("ok").cast("long")).alias("correct"))


def adaptive_ece(df: DataFrame, confidence: str, correct: str, key: str, bins: int = 15) -> DataFrame:
    """Mean gap of accuracy and confidence over bins of equal numbers of rows in confidence order."""
    from .sample import contiguous_shards

    binned = contiguous_shards(df.select(confidence, key, F.col(correct).cast("double").alias("_ok")), bins, confidence, key)
    per = binned.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.avg("_ok").alias("acc"), F.avg(confidence).alias("conf"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.sum("n").alias("tokens"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def cross_entropy(x: Column, target: Column) -> Column:
    """Null for ignored targets."""
    return F.when(target != IGNORE, -log_probability(x, target))


def focal(x: Column, target: Column, gamma: float = 2.0, alpha: float = 1.0) -> Column:
    lp = log_probability(x, target)
    return F.when(target != IGNORE, alpha * F.pow(1 - F.exp(lp), F.lit(gamma)) * -lp)


def smoothed(x: Column, target: Column, epsilon: float = 0.1) -> Column:
    """Cross entropy with epsilon spread over the other finite classes; none where the target is the only one."""
    lse = logsumexp(x)
    others = F.filter(F.transform(x, lambda v, i: F.when((i != target) & (v > float("-inf")), v)), lambda v: v.isNotNull())
    n = F.size(others)
    rest = let(lse, lambda y: F.aggregate(others, F.lit(0.0), lambda a, v: a + (y - v)))
    own = lse - F.get(x, target)
    return F.when(target == IGNORE, None).when(n == 0, own).otherwise((1 - epsilon) * own + epsilon / n * rest)


LOSSES = {"ce": cross_entropy, "focal": focal}


def loss(name: str, x: Column, target: Column, epsilon: float = 0.0) -> Column:
    name = name.lower().strip()
    if name == "ce" and epsilon:
        return smoothed(x, target, epsilon)
    if name not in LOSSES:
        raise ValueError(f"unknown loss: {name}")
    return LOSSES[name](x, target)


def mean_loss(df: DataFrame, loss_column: str) -> DataFrame:
    """Mean over rows that are not ignored; 0 if there are none."""
    return df.agg((F.coalesce(F.sum(loss_column), F.lit(0.0)) / F.greatest(F.count(loss_column), F.lit(1))).alias("loss"), F.count(loss_column).alias("tokens"))


def weighted_mean(value: Column, tokens: Column) -> Column:
    """Over all ranks, by their tokens."""
    return F.sum(value * tokens) / F.greatest(F.sum(tokens), F.lit(1))


def two_pass(conditional: Column, unconditional: Column, weight: float) -> Column:
    return conditional if weight == 0 else conditional + weight * F.coalesce(unconditional, F.lit(0.0))


def top_k_sentences(beams: Column, target: Column, k: int) -> Column:
    return F.exists(F.slice(beams, 1, k), lambda b: b == target)


def masked(x: Column, allowed: Column) -> Column:
    """Logits with minus infinity where not allowed."""
    return F.zip_with(x, allowed, lambda v, ok: F.when(ok, v).otherwise(F.lit(float("-inf"))))


def rank_scale(local: Column, total: Column, ranks: int) -> Column:
    """What a rank's mean loss is multiplied by, so that the mean over ranks is the mean over all tokens."""
    return F.lit(ranks) * local / F.greatest(total, F.lit(1))


#: Confidences of a state are counted in so many ranges of equal width; a state never has more rows than that and one.
RANGES = 1 << 16
#: Units of a confidence in a state: sums are whole numbers, so that they are the same in any order.
UNIT = 1 << 30
#: Range number of a state's row that has its sentences.
SENTENCES = -1
COUNTERS = ("tokens", "top1", "top3", "top5", "hits", "mass", "sentences", "correct")


def token_counts(x: Column, target: Column, top_k: int) -> Column:
    """A token's share of a state: its range and counters.  Equal logits: the lower class comes first."""
    k = F.least(F.lit(top_k), F.size(x))
    confidence = F.least(F.lit(1.0), top_mass(x, k))
    one = lambda c: c.cast("long")

    def counts(rank: Column) -> Column:
        return F.struct(
            F.least(F.lit(RANGES - 1), F.floor(confidence * RANGES)).cast("int").alias("range"), F.lit(1).cast("long").alias("tokens"), *[one(rank < n).alias(f"top{n}") for n in (1, 3, 5)],
            one(rank < top_k).alias("hits"), F.round(confidence * UNIT).cast("long").alias("mass"), F.lit(0).cast("long").alias("sentences"), F.lit(0).cast("long").alias("correct"), (rank < 1).alias("right"),
        )

    return let(rank_of(x, target), counts)


def state(sentences: DataFrame, logits: str, targets: str, by: list[str] | None = None, bins: int = 15, top_k: int = 5) -> DataFrame:
    """Metric state of sentences (``logits``: a list of logits for each token, ``targets``: its classes), for each value of ``by``.

    One row for each range of confidences that occurs, and one for the sentences: columns bins, top_k, range and COUNTERS.
    It is a plain sum over rows, so states of parts merge to that of the whole, and no list of confidences is kept.  Null and
    empty sentences count as correct ones without tokens.
    """
    by = by or []
    tokens = F.transform(F.arrays_zip(F.col(logits).alias("x"), F.col(targets).alias("t")), lambda z: token_counts(z["x"], z["t"], top_k))
    rows = sentences.select(*by, F.coalesce(tokens, F.array()).alias("_t"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = F.struct(F.lit(SENTENCES).alias("range"), *[zero.alias(c) for c in COUNTERS[:-2]], one.alias("sentences"), F.forall("_t", lambda x: x["right"]).cast("long").alias("correct"), F.lit(True).alias("right"))
    rows = rows.select(*by, F.explode(F.concat(F.array(whole), "_t")).alias("x")).select(*by, "x.range", *[f"x.{c}" for c in COUNTERS])
    return summed(rows.select(*by, F.lit(bins).alias("bins"), F.lit(top_k).alias("top_k"), "range", *COUNTERS), by)


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "bins", "top_k", "range").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def merge(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of all ranks as one (for each value of ``by``); states of differing settings are an error."""
    by = by or []
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit(f"states of differing {c}")).cast("int")).alias(c)
    agreed = states.groupBy(*by).agg(one("bins"), one("top_k"))
    sums = states.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    # one row for each value of ``by``
    joined = sums.join(F.broadcast(agreed), by) if by else sums.crossJoin(F.broadcast(agreed))
    return joined.select(*by, "bins", "top_k", "range", *COUNTERS)


def finalised(state_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tokens, acc, top3_acc, top5_acc, sentences, s_acc and ece of a state; 0 where there is nothing.

    ece: tokens in order of confidence fall into bins of equal numbers, the first ones a token larger; of a range that a bin's
    border cuts, each side gets its share.  It differs from ``adaptive_ece`` by at most the width of such ranges.
    """
    by = by or []
    n = F.sum("tokens").over(Window.partitionBy(*by))  # RANGES + 1 rows for each value of ``by``
    rows = state_rows.withColumn("_n", n).withColumn("_to", F.sum("tokens").over(Window.partitionBy(*by).orderBy("range"))).where("tokens > 0")
    rows = rows.withColumn("_from", F.col("_to") - F.col("tokens"))
    small, more = F.floor(F.col("_n") / F.col("bins")), F.col("_n") % F.col("bins")
    begin = lambda b: b * small + F.least(b, more)
    of = lambda at: F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1))))
    cut = rows.withColumn("bin", F.explode(F.sequence(of(F.col("_from")), of(F.col("_to") - 1))))
    share = (F.least(F.col("_to"), begin(F.col("bin") + 1)) - F.greatest(F.col("_from"), begin(F.col("bin")))) / F.col("tokens")
    bins = cut.groupBy(*by, "bin", "_n").agg(F.abs(F.sum(share * F.col("hits")) - F.sum(share * F.col("mass")) / UNIT).alias("_gap"))
    gaps = bins.groupBy(*by).agg((F.sum("_gap") / F.max("_n")).alias("ece"))
    totals = state_rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tokens", "top1", "top3", "top5", "sentences", "correct")])
    joined = totals.join(gaps, by, "left") if by else totals.crossJoin(gaps)  # one row each
    shares = [ratio(F.col(a), F.col(b)).alias(c) for a, b, c in (("top1", "tokens", "acc"), ("top3", "tokens", "top3_acc"), ("top5", "tokens", "top5_acc"), ("correct", "sentences", "s_acc"))]
    return joined.select(*by, "tokens", *shares[:3], "sentences", shares[3], F.coalesce("ece", F.lit(0.0)).alias("ece"))


def expert_choice(tokens: DataFrame, key: str, affinity: str, experts: int, choice: int = 2) -> DataFrame:
    """Each expert takes its best tokens, max(1, N * choice // experts) of them; weights are sigmoids.

    Experts' scores are counted by value ranges first; ranges well inside are taken whole, and only the range that the border falls into is
    ranked, so no task ranks a share of all tokens.
    """
    pairs = tokens.select(key, F.posexplode(F.slice(affinity, 1, experts)).alias("expert", "score")).select(key, "expert", F.col("score").cast("double").alias("score"))
    capacity = max(1, tokens.count() * choice // experts)
    return top_of_groups(pairs, "expert", "score", key, capacity).withColumn("weight", 1 / (1 + F.exp(-F.col("score"))))


def top_of_groups(rows: DataFrame, group: str, score: str, key: str, n: int, ranges: int = 1024) -> DataFrame:
    """The ``n`` rows of each group with the largest scores, ties to the smaller key."""
    bounds = rows.groupBy(F.col(group).alias("_g")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_high") - F.col(score)) / (F.col("_high") - F.col("_low")) * ranges)).otherwise(0)
    dealt = rows.join(F.broadcast(bounds), F.col(group) == F.col("_g")).withColumn("_at", at).drop("_g", "_low", "_high")  # a row for each group
    # ``ranges`` + 1 rows for each group
    counts = dealt.groupBy(group, "_at").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_at")) - F.col("_n"))
    marked = dealt.join(F.broadcast(counts.where(F.col("_before") < n).select(F.col(group).alias("_g"), F.col("_at").alias("_b"), "_n", "_before")), (F.col(group) == F.col("_g")) & (F.col("_at") == F.col("_b")))
    whole = marked.where(F.col("_before") + F.col("_n") <= n).select(*rows.columns)
    edge = marked.where(F.col("_before") + F.col("_n") > n).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    return whole.unionByName(edge.where(F.col("_rank") + F.col("_before") <= n).select(*rows.columns))


def swiglu(rows: DataFrame, key: str, vector: str, expert: str, weights: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], scale: str | None = None) -> DataFrame:
    """key, out: each vector through its expert, (silu(x gate) * (x up)) down, times ``scale``; one product for all rows of an expert in a batch.

    ``weights``: for each expert the matrices up, gate (dim x hidden) and down (hidden x dim), which go to every worker; their size is the model's.
    """
    held = rows.sparkSession.sparkContext.broadcast(weights)
    dim = next(iter(weights.values()))[2].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            which = batch.column(2).to_numpy(zero_copy_only=False)
            out = np.zeros((len(x), dim))
            for e in np.unique(which):
                up, gate, down = held.value[int(e)]
                own = which == e
                g = x[own] @ gate
                out[own] = (g / (1 + np.exp(-g)) * (x[own] @ up)) @ down
            out *= batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            at = pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], [key, "out"])

    factor = F.col(scale) if scale else F.lit(1.0)
    chosen = rows.select(key, vector, F.col(expert).cast("long").alias("_expert"), factor.cast("double").alias("_scale"))
    return chosen.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, out array<double>")


def vector_sums(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key and the sum of its vectors, added up in each task before they are shuffled."""
    sums = rows.groupBy(key).agg(*[F.sum(F.get(vector, F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return sums.select(key, F.array(*[f"_{i}" for i in range(dim)]).alias(vector))


def mixture(tokens: DataFrame, key: str, vector: str, affinity: str, weights: dict[int, tuple], common: tuple, choice: int = 2) -> DataFrame:
    """key, out: each token's vector through the common expert, plus what the experts that chose it make of it, by their weights.

    Keys are unique.  A token that no expert chose has the common part alone.
    """
    routed = expert_choice(tokens.select(key, affinity), key, affinity, len(weights), choice).select(key, "expert", "weight")
    vectors = tokens.select(key, vector)
    dim = common[2].shape[1]
    own = swiglu(vectors.withColumn("_all", F.lit(0)), key, vector, "_all", {0: common})
    return vector_sums(own.unionByName(swiglu(routed.join(vectors, key), key, vector, "expert", weights, "weight")), key, "out", dim)
