"""Problem 6: encoding a whole corpus with a public byte-level BPE tokenizer.

Each pre-token is merged with a segment tree over the ranks of its adjacent pairs. The root holds the lowest rank, the
descent to the left child on ties finds the leftmost position of it, and a merge changes three leaves, so a pre-token of
n bytes costs O(n log n) however long it is. Encoded pre-tokens and white-space free chunks are remembered per Python worker.

Defined results: a null, or an empty text has an empty list of ids. Strings of special tokens are ordinary text. Every input row
gives one output row, repeated rows included. Lone surrogates cannot occur in Spark strings. Further columns are dropped.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before merging, as published with the rank file.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space inside a run of white space: there, cutting before the space would change the pre-tokens.
_UNSAFE = regex.compile(r"\s (?:\s|\Z)")
_NONE = 1 << 60
#: Size up to which a file is taken for a rank file.
RANK_FILE_BYTES = 64 << 20
#: Entries a worker remembers before it starts over; bounds memory, changes no result.
CACHE_ENTRIES = 300_000


def rank_file(name: str = "byte_bpe_50k.tiktoken", directory: str | None = None) -> bytes:
    """The rank file's bytes, read whole, once on the driver. Its size is that of a vocabulary, whatever the corpus; a larger file is refused."""
    path = os.path.join(directory or os.environ.get("LENFORGE_TOKENIZERS", DEFAULT_TOKENIZERS), name)
    if os.path.getsize(path) > RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than a rank file")
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    ranks = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PairTree:
    """Segment tree over the ranks of adjacent pairs; ``top()`` is the leftmost pair of lowest rank."""

    __slots__ = ("size", "low")

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        low = [_NONE] * (2 * size)
        low[size : size + len(ranks)] = ranks
        for i in range(size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b
        self.size, self.low = size, low

    def top(self) -> tuple[int, int]:
        low, i = self.low, 1
        rank = low[1]
        while i < self.size:
            i *= 2
            if low[i] != rank:
                i += 1
        return rank, i - self.size

    def set(self, at: int, rank: int) -> None:
        low, i = self.low, at + self.size
        low[i] = rank
        i //= 2
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            best = a if a <= b else b
            if low[i] == best:
                break
            low[i] = best
            i //= 2


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    get = ranks.get
    tree = PairTree([get(piece[i : i + 2], _NONE) for i in range(n - 1)])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while True:
        rank, i = tree.top()
        if rank == _NONE:
            break
        j = after[i]
        parts[i] = parts[i] + parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if j < n - 1:
            tree.set(j, _NONE)
        if k < n:
            before[k] = i
            tree.set(i, get(parts[i] + parts[k], _NONE))
        elif i < n - 1:
            tree.set(i, _NONE)
        h = before[i]
        if h >= 0:
            tree.set(h, get(parts[h] + parts[i], _NONE))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts to little-endian int32 buffers."""

    def __init__(self, data: bytes):
        self.ranks = parse_ranks(data)
        self.find = regex.compile(SPLIT_PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array(merge_bytes(piece.encode("utf-8"), self.ranks), dtype="<i4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and what follows it up to the next space."""
        ids = b"".join(map(self._piece, self.find(" " + chunk)))
        if len(chunk) <= 64:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return b"".join(map(self._piece, self.find(text)))
        # Pre-tokens never span such a space, so each chunk that begins with one is encoded for itself.
        first, *rest = text.split(" ")
        chunks = self.chunks
        try:
            tail = b"".join(map(chunks.__getitem__, rest))
        except KeyError:
            tail = b"".join([chunks.get(word) or self._chunk(word) for word in rest])
        return (b"".join(map(self._piece, self.find(first))) if first else b"") + tail


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The worker's encoder of this rank file."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _buffers(batch: pa.RecordBatch, column: str, enc: Encoder) -> list[bytes]:
    return [enc.encode(t) if t else b"" for t in batch.column(column).to_pylist()]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: bytes | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row of ``df``; one narrow stage, no shuffle."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(ranks or rank_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            parts = _buffers(batch, text_col, enc)
            ends = np.cumsum(np.fromiter(chain((0,), map(len, parts)), dtype=np.int64)) // 4
            ids = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", ranks: bytes | None = None) -> DataFrame:
    """``df`` without the text, with the number of ids of each row's text; one narrow stage, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(ranks or rank_file())
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = pa.array([len(b) // 4 for b in _buffers(batch, text_col, enc)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], names=[*keep, out_col])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(run, f"{schema}, `{out_col}` bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_corpus(docs.select(F.col("doc_id"), F.col("text")))
