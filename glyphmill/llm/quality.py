"""A quality classifier: random-indexing vectors pooled per document, and a two-layer numpy network.

Every context has a sparse random index vector that a hash gives.  A word's vector is the sum of the index
vectors of the words around it in all documents; words share vectors by hash, so that their number is fixed and none is left out.  Byte trigrams,
which every word has, take their index vectors themselves.  A document is the mean of both.  The network's
probabilities are calibrated by a temperature on a part of the sample it is not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, lean, mix, save, slices, word_hashes, words_of

#: Labelled documents that the classifier is fitted on, at most: those with the least hashes of their ids.
SAMPLE = 6000
#: Word vectors; words with the same hash modulo this share one.
VECTORS = 1 << 14
#: Parts of the vectors that are added up apart.
PIECES = 256
WORD_DIM, FORM_DIM, NONZERO = 64, 128, 4
BUCKETS = 4096
#: Bytes of texts whose features are computed at once: a word takes up some hundred times its bytes.
AT_ONCE = 1 << 18
HIDDEN = 32


def _sparse(rows: int, dim: int, seed: int) -> np.ndarray:
    """Index vectors: NONZERO entries of 1 or -1 each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((rows, dim), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(rows), rng.integers(dim, size=rows)] += rng.choice([-1.0, 1.0], size=rows)
    return out


@dataclass
class Words:
    """Vectors by the hash of a word."""

    vectors: np.ndarray

    def lookup(self, values: np.ndarray) -> np.ndarray:
        return (mix(values) % np.uint64(VECTORS)).astype(np.int64)


def context_sums(values: np.ndarray, bounds: np.ndarray, total: np.ndarray, reach: int = 2) -> None:
    """Adds to the vectors the index vectors of all words at most ``reach`` away from each word."""
    row = (mix(values) % np.uint64(VECTORS)).astype(np.int32) * WORD_DIM
    text = np.searchsorted(bounds, np.arange(len(values)), side="right").astype(np.int32)
    for j in range(NONZERO):
        h = mix(values + np.uint64(j + 1))
        place = (h % np.uint64(WORD_DIM)).astype(np.int32)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        keys, weights = [], []
        for step in range(1, reach + 1):
            for near, far in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                ok = text[near] == text[far]
                keys.append(row[near][ok] + place[far][ok])
                weights.append(sign[far][ok])
        total += np.bincount(np.concatenate(keys), np.concatenate(weights), len(total)).astype(np.int64)


def pooled(column: pa.Array, words: Words) -> np.ndarray:
    """Vectors of all texts: mean word vector, mean trigram vector, shares of words that repeat near ones, and length."""
    raw, offsets = joined(column)
    start, end, first = words_of(raw, offsets)
    values = word_hashes(raw, start, end)
    row = words.lookup(values)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    count = np.maximum(np.diff(first), 1)[:, None]
    total = np.zeros((n, WORD_DIM))
    if len(row):
        begin = np.flatnonzero(np.diff(text, prepend=-1))
        total[text[begin]] = np.add.reduceat(words.vectors[row], begin, axis=0, dtype=np.float64)
    form = np.zeros((n, FORM_DIM))
    if len(raw) > 2:
        gram = raw[:-2].astype(np.uint32) * np.uint32(65536) + raw[1:-1].astype(np.uint32) * np.uint32(256) + raw[2:]
        bucket = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        owner = np.searchsorted(offsets, np.arange(len(gram)), side="right") - 1
        inside = np.arange(len(gram)) + 2 < offsets[1:][owner]
        for a in range(0, n, 128):
            z = min(a + 128, n)
            low, high = np.searchsorted(owner, [a, z])
            here = inside[low:high]
            hist = np.bincount((owner[low:high][here] - a) * BUCKETS + bucket[low:high][here], minlength=(z - a) * BUCKETS).reshape(z - a, BUCKETS).astype(np.float32)
            form[a:z] = hist @ _FORM / np.maximum(hist.sum(axis=1), 1)[:, None]
    # how often a word is the one before it, or one of the two before that, again
    again = [np.bincount(text[k:][(values[k:] == values[:-k]) & (text[k:] == text[:-k])], minlength=n) for k in (1, 2, 3)]
    return np.hstack([total / count, form * 8, again[0][:, None] / count, (again[1] + again[2])[:, None] / count, np.log1p(np.diff(first))[:, None] / 4])


_FORM = _sparse(BUCKETS, FORM_DIM, 7)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> Network:
    """Fit on the rows not held, by full-batch Adam; temperature by the likelihood of those held."""
    rng = np.random.Generator(np.random.PCG64(11))
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    a, t = (x[~held] - net.mean) / net.scale, y[~held].astype(float)
    if not len(t):
        return net
    names = ("w1", "b1", "w2", "b2")
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    for i in range(1, rounds + 1):
        h = np.tanh(a @ net.w1 + net.b1)
        p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
        d = (p - t) / len(t)
        back = np.outer(d, net.w2) * (1 - h * h)
        grads = {"w2": h.T @ d + decay * net.w2, "b2": d.sum(), "w1": a.T @ back + decay * net.w1, "b1": back.sum(axis=0)}
        for k in names:
            m, v = state[k]
            m, v = 0.9 * m + 0.1 * grads[k], 0.999 * v + 0.001 * grads[k] ** 2
            state[k] = (m, v)
            setattr(net, k, getattr(net, k) - 0.01 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8))
    if held.any():
        z, t = net.logits(x[held]), y[held]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.logaddexp(0, np.where(t == 1, -z, z) / c).mean() for c in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


def word_vectors(docs: DataFrame) -> Words:
    """Random-indexing vectors from the contexts of all words of all documents: the tasks' sums are added up piece by piece."""
    n = VECTORS * WORD_DIM
    size = n // PIECES

    def packed(piece: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([pa.compress(total.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["piece", "sums"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for a, z in slices(batch):
                raw, offsets = joined(batch.column("text").slice(a, z - a))
                start, end, first = words_of(raw, offsets)
                context_sums(word_hashes(raw, start, end), first[1:], total)
        for piece in range(PIECES):
            if (part := total[piece * size : (piece + 1) * size]).any():
                yield packed(piece, part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column("piece").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(pa.decompress(x.as_buffer(), 8 * size, codec="zstd"), "<i8")
                held[piece] = held[piece] + part if piece in held else part
        for piece, part in held.items():
            yield packed(piece, part)

    schema = "piece int, sums binary"
    sums = docs.select("text").mapInArrow(lean(contexts), schema).repartition("piece").mapInArrow(lean(add), schema)
    total = np.zeros(n)
    for r in sums.collect():  # one row for each piece
        total[r.piece * size : (r.piece + 1) * size] = np.frombuffer(pa.decompress(bytes(r.sums), 8 * size, codec="zstd"), "<i8")
    vectors = total.reshape(-1, WORD_DIM)
    return Words((vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Words, Network]:
    """Word vectors of all documents, and the network fitted on at most ``sample`` labelled ones outside fold 2."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(fold() != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without document take up no place
    rows = rows.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most ``sample`` rows
    chosen = save(chosen.select("doc_id", "quality", "text"))

    words = word_vectors(docs)
    # at most ``sample`` vectors
    got = sorted(vectorised(chosen, words, "doc_id", "quality").collect(), key=lambda r: (r.doc_id, r.vector))
    if not len(got):
        dim = WORD_DIM + FORM_DIM + 3
        return words, Network(np.zeros(dim), np.ones(dim), np.zeros((dim, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 3.0)
    x = np.array([np.frombuffer(r.vector, np.float64) for r in got])
    y = np.array([r.quality for r in got])
    held = mix(np.array([r.doc_id for r in got], dtype=np.int64).view(np.uint64)) % np.uint64(5) == 0
    return words, fit(x, y, held)


def vectorised(docs: DataFrame, words: Words, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, limit=AT_ONCE):
                part = batch.slice(a, z - a)
                data = [v.tobytes() for v in pooled(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(data, pa.binary())], [*keep, "vector"])

    df = docs.select(*keep, "text")
    fields = ", ".join(f"{c} {t}" for c, t in df.select(*keep).dtypes)
    return df.mapInArrow(lean(run), f"{fields}, vector binary")


def score(docs: DataFrame, words: Words, network: Network) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1.  Null and empty texts are texts without words."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != "score"]
    schema = T.StructType([f for f in docs.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, limit=AT_ONCE):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(network.scores(pooled(part.column("text"), words)))], [*names, "score"])

    return docs.select(*names).mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold).

    Labels are learnt only from ids whose crc32 as text modulo 4 is not 2; of labels given twice the larger
    counts; labels without document and documents without label are fine; without any label the score
    is the same above the threshold for all.  Rows and other columns of ``docs`` stay, but for columns ``score`` and ``predicted`` of its own, which are replaced;
    null and empty texts are texts without words, and very long ones count whole; repeated rows and equal texts have equal scores; no documents: no rows.
    """
    words, network = train(docs, labels, sample)
    return score(docs, words, network).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
