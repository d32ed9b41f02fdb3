"""Token ids in blocks coded by a static range asymmetric numeral system (rANS).

All blocks share one frequency table, counted over the whole corpus.  A block interleaves independent
coder states ("lanes"), so that numpy codes a row of lanes at once, and carries its
states, a checksum and the place of its first token: any block can be decoded alone.

Tokens of a document are looked up piece by piece.  Byte-level BPE never merges over a space
between two other characters, so a text is cut there, and each distinct piece is encoded
by the tokenizer only once for each worker.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, kept, lean, release, save, scratch_root, slices, small_batches

#: Fixed value: the split pattern of the byte-level tokenizer.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CUT = regex.compile(r"(?<=\S)(?= \S)", regex.V1)
#: The tokenizer's letter for each byte: itself where it is printable, else the next from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
SPACE = chr(LETTERS[32])
CACHE_PIECES = 300_000
#: Marks that the split pattern takes together; the apostrophe can begin a token of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
MAGIC = b"GRA1"
HEADER = struct.Struct("<4sBxHIII")  # magic, scale bits, lanes, tokens, words, crc32 of the tokens as uint32


class Irregular(Exception):
    """A piece begins or ends with white space, so the cuts around it are not safe."""


class Pieces(dict):
    """Ids of pieces preceded by a space, in two generations: when the younger is full the older goes, so what recurs stays."""

    def __init__(self, compute) -> None:
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts like ``Tokenizer.encode(text, add_special_tokens=False)``, with memory."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packers = [struct.Struct(f"<{n}{'H' if self.type.itemsize == 2 else 'I'}").pack for n in range(32)]
        self.after_space = Pieces(self.compute)
        self.tokens: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def compute(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.shown(SPACE + piece) if piece.isascii() else self.letters(" " + piece)
        stem = piece.rstrip(MARKS)
        if stem.isalpha():
            known = self.after_space.get(stem) or self.after_space.older.get(stem) or self.letters(" " + stem)
            return known + self.token(piece[len(stem) :])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Irregular
        return self.whole(" " + piece)

    def letters(self, token: str) -> bytes:
        """Ids of one token of the split pattern."""
        return self.shown(token.encode().decode("latin-1").translate(LETTERS))

    def shown(self, token: str) -> bytes:
        """Ids of a token in the tokenizer's letters."""
        ids = [t.id for t in self.tokenizer.model.tokenize(token)]
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else np.array(ids, dtype=self.type).tobytes()

    def token(self, token: str) -> bytes:
        ids = self.tokens.get(token)
        if ids is None:
            if len(self.tokens) >= CACHE_PIECES:
                self.tokens.clear()
            ids = self.tokens[token] = self.letters(token)
        return ids

    def whole(self, piece: str) -> bytes:
        """Ids of a piece by its tokens of the split pattern."""
        return b"".join(map(self.token, SPLIT.findall(piece)))

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.after_space.__getitem__, []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(self.direct(text))
                continue
            parts = text.split(" ")
            try:
                if not parts[0] or parts[0][0].isspace() or parts[0][-1].isspace():
                    raise Irregular
                out.append(self.whole(parts[0]) + b"".join(map(get, islice(parts, 1, None))))
            except Irregular:
                out.append(b"".join(map(self.cut_piece, CUT.split(text))))
        return out

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """``encode`` of a whole column (null: empty): Arrow finds its distinct pieces, memory is asked once for each."""
        column = pa.compute.fill_null(column, "")
        parts = pa.compute.split_pattern(column, " ")
        begin = np.asarray(parts.offsets)
        pieces = parts.values.dictionary_encode()
        codes = np.array(pieces.indices)
        del parts
        distinct = pieces.dictionary.to_pylist()
        odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in distinct], dtype=bool)
        get = self.after_space.__getitem__
        known = [b"" if o else get(p) for p, o in zip(distinct, odd.tolist(), strict=True)]
        texts = column.to_pylist()
        alone = (np.bitwise_or.reduceat(odd[codes], begin[:-1]) if texts else odd).tolist()
        for i, text in enumerate(texts):
            alone[i] = alone[i] or any(s in text for s in self.special)
            known.append(b"" if alone[i] else self.whole(distinct[codes[begin[i]]]))
        codes[begin[:-1]] = len(odd) + np.arange(len(texts))  # no space before the first piece of a text
        ids = np.frombuffer(b"".join(known), self.type)
        size = np.fromiter(map(len, known), np.int32, len(known)) // self.type.itemsize
        n = size[codes]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat((np.cumsum(size, dtype=np.int32) - size)[codes] - (ends - n), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = ids[at]
        bounds = np.concatenate([np.zeros(1, np.int32), ends])[begin].tolist()
        return [self.encode([t])[0] if x else ids[a:z].tobytes() for t, x, a, z in zip(texts, alone, bounds[:-1], bounds[1:], strict=True)]

    def cut_piece(self, piece: str) -> bytes:
        """Ids of a part of a text between safe cuts."""
        known = self.after_space.get(piece[1:]) if piece[:1] == " " else None
        return self.whole(piece) if known is None else known


def encoder(path: str) -> PieceEncoder:
    return kept(("encoder", path), lambda: PieceEncoder(path))


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies with sum 2**bits, at least 1 for each id that occurs."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.where(np.arange(len(counts)) == 0, room, 0)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * room).astype(np.int64)), 0)
    spare = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    at = 0
    while spare:
        i = order[at % len(order)]
        step = spare if spare > 0 else -min(-spare, int(freq[i]) - 1)
        freq[i] += step
        spare -= step
        at += 1
    return freq


class Rans:
    """Codes blocks of ids with fixed frequencies (sum 2**bits)."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lanes: int) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        bits = np.uint64(self.bits)
        room = np.uint64(63 - self.bits)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        for a in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
            z = min(a + lanes, n)
            x, s = state[: z - a], ids[a:z]
            freq = self.freq[s]
            full = np.flatnonzero(x >= freq << room)
            if len(full):
                over = x[full]
                words.append(over.astype(np.uint32))
                x[full] = over >> HALF
            q = x // freq  # an id without frequency can't be coded; the checksum of the block tells
            state[: z - a] = (q << bits) + (x - q * freq) + self.cum[s]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return HEADER.pack(MAGIC, self.bits, lanes, n, len(stream), zlib.crc32(ids.astype("<u4").tobytes())) + state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, frame: bytes) -> np.ndarray:
        magic, bits, lanes, n, n_words, crc = HEADER.unpack_from(frame)
        if magic != MAGIC or bits != self.bits:
            raise ValueError("not a block of this table")
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        state = np.frombuffer(frame, "<u8", lanes, HEADER.size).astype(np.uint64)
        words = np.frombuffer(frame, "<u4", n_words, HEADER.size + 8 * lanes).astype(np.uint64)
        out = np.empty(n, dtype=np.uint32)
        shift, mask, at = np.uint64(bits), np.uint64((1 << bits) - 1), 0
        for a in range(0, n, lanes):
            z = min(a + lanes, n)
            x = state[: z - a]
            slot = x & mask
            out[a:z] = s = self._symbol[slot]
            x = self.freq[s] * (x >> shift) + slot - self.cum[s]
            short = np.flatnonzero(x < LOW)
            if len(short):
                x[short] = (x[short] << HALF) | words[at : at + len(short)]
                at += len(short)
            state[: z - a] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != crc or at != n_words:
            raise ValueError("a block is damaged")
        return out


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of each document, where it is: doc_id, tie (a hash of the text), n, ids (zstd), counts (one row with them for each task, the other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.type).tobytes()
        counts = np.zeros(max(enc.size, end_id + 1), dtype=np.int64)
        names = ["doc_id", "tie", "n", "ids", "counts"]
        for batch in batches:
            for a, z in slices(batch, limit=20 << 20):
                part = batch.slice(a, z - a)
                data = [x + end for x in enc.encode_column(part.column("text"))]
                n = pa.array([len(x) // enc.type.itemsize for x in data], pa.int64())
                counts += np.bincount(np.frombuffer(b"".join(data), enc.type), minlength=len(counts))
                packed = [pa.compress(x, codec="zstd", asbytes=True) for x in data]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), n, pa.array(packed, pa.binary()), pa.nulls(len(part), pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return docs.mapInArrow(lean(run, keeps=True), "doc_id long, tie long, n long, ids binary, counts binary")


def total_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids: tables of the tasks are added on the executors, a few at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("counts"):
                c = np.frombuffer(x.as_py(), "<i8")
                total = c.copy() if total is None else total + c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    tables = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(lean(add, keeps=True), "counts binary")
    tables = tables.repartition(8).mapInArrow(lean(add, keeps=True), "counts binary")
    parts = [np.frombuffer(r.counts, "<i8") for r in tables.collect()]
    return sum(parts) if parts else np.zeros(1, np.int64)


def write_blocks(docs: DataFrame, path: str, end_id: int = 2, bits: int = 20, block: int = 1 << 20, lanes: int = 4096, to: str | None = None) -> tuple[SparkSession, str]:
    """Encode every whole text, append ``end_id`` to each, write blocks in ascending doc_id order; returns what ``read_blocks`` takes.

    The files below ``to`` (a folder of the shared one if it is not given) need nothing else to be read.  ``blocks``: shard,
    first (a block's first token in the shard), frame, and for each piece of a document in it seq, doc_id, n.  ``header``, one row: the scale bits, the
    shared frequency table, the tokenizer's file name, the end id, and the shards with the tokens before each.
    Null and empty texts have the end id only; a document longer than a block lies in several; null doc_ids come first; rows of one doc_id are ordered
    by a hash of the text; an empty table makes no block.
    """
    spark = docs.sparkSession
    to = to or f"{scratch_root(spark)}/glyphmill-{uuid.uuid4().hex}"
    tokens = save(tokenize(docs, path, end_id))
    counts = total_counts(tokens)
    # twice as many slots as ids at least
    bits = max(bits, int(len(counts) * 2).bit_length())
    rans = Rans(scaled(counts, bits), bits)
    width = "<u2" if len(rans.freq) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        who: list[tuple[int, int | None, int]] = []
        seq = first = size = 0

        def flush() -> pa.RecordBatch:
            frame = rans.encode(np.concatenate(held), lanes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([frame], pa.binary()), *(pa.array([[w[i] for w in who]], pa.list_(pa.int64())) for i in range(3))],
                ["shard", "first", "frame", "seq", "doc_id", "n"],
            )
            held.clear()
            who.clear()
            return out

        for batch in batches:
            for doc_id, packed, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n")), strict=True):
                ids = np.frombuffer(pa.decompress(packed, n * np.dtype(width).itemsize, codec="zstd", asbytes=True), width)
                while len(ids):
                    part = ids[: block - size]
                    held.append(part)
                    who.append((seq, doc_id, len(part)))
                    size += len(part)
                    ids = ids[len(part) :]
                    if size == block:
                        yield flush()
                        first, size = first + size, 0
                seq += 1
        if who:
            yield flush()

    # only now are rows dealt out: ids are a fraction of their texts
    key = F.asc_nulls_first("doc_id")
    ordered = tokens.where("counts IS NULL").select("doc_id", "tie", "n", "ids").repartitionByRange(key, "tie").sortWithinPartitions(key, "tie")
    with small_batches(spark):
        ordered.mapInArrow(lean(run), "shard long, first long, frame binary, seq array<long>, doc_id array<long>, n array<long>").write.option("compression", "zstd").parquet(f"{to}/blocks")
    discard(tokens)
    release(spark)
    blocks = spark.read.parquet(f"{to}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).collect()  # a row for each task
    shards, before, total = [], [], 0
    for shard, n in sorted(map(tuple, sums)):
        shards.append(shard)
        before.append(total)
        total += n
    table = pa.compress(rans.freq.astype("<u4").tobytes(), codec="zstd", asbytes=True)
    header = [(bits, len(rans.freq), bytearray(table), os.path.basename(path), end_id, shards, before)]
    spark.createDataFrame(header, "bits int, ids int, frequencies binary, tokenizer string, end_id int, shard array<long>, before array<long>").coalesce(1).write.parquet(f"{to}/header")
    return spark, to


def coder_of(bits: int, ids: int, frequencies: bytes) -> Rans:
    """The coder of a header."""
    return Rans(np.frombuffer(pa.decompress(frequencies, 4 * ids, codec="zstd", asbytes=True), "<u4").astype(np.int64), bits)


def shifted(crc: int, n_bytes: int) -> int:
    """The CRC-32 register after n zero bytes: crc times x**(8 n) modulo the polynomial (reflected)."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, base = 1 << 31, 1 << 23  # x**0, x**8
    while n_bytes:
        if n_bytes & 1:
            power = times(power, base)
        base = times(base, base)
        n_bytes >>= 1
    return times(crc, power)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks below a path, each alone, and give for each document doc_id, start, n_tokens, ids_crc32."""
    header = spark.read.parquet(f"{path}/header").first()
    rans = coder_of(header.bits, header.ids, bytes(header.frequencies))
    base = dict(zip(header.shard, header.before, strict=True))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, frame, seq, doc_id, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "frame", "seq", "doc_id", "n")), strict=True):
                body = memoryview(rans.decode(frame).astype("<u4").tobytes())
                ends = np.cumsum(n)
                crcs = [zlib.crc32(body[4 * (z - m) : 4 * z]) for z, m in zip(ends.tolist(), n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array(seq, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(first + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], ["shard", "seq", "doc_id", "first", "n", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = shifted(crc, 4 * p["n"]) ^ p["crc"]
                crcs.append(crc)
            start = [base[s] + f for s, f in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = blocks.mapInArrow(lean(run), "shard long, seq long, doc_id long, first long, n long, crc long")
    docs = parts.groupBy("shard", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "n", "crc"))).alias("parts"))
    return docs.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
