"""Problem 4: near-duplicate samples by MinHash with Bayesian pruning of candidates and exact verification.

Text: instruction and response with a space between, lower case, without punctuation; its features are the distinct runs of
three words (a shorter text is one run). Similarity: shared runs over all runs of both.

1. Equal texts are one text, named by a 64-bit key of its words (two texts with one key are told apart and get others); each text is compared once.
2. Each text has ``HASHES`` min-hashes. It enters one bucket per band of ``ROWS`` of them; texts that share a bucket are candidates.
3. Candidates compare further min-hashes in steps. With a uniform prior on the similarity, the number m of agreements in n
   has the posterior Beta(m+1, n−m+1); a pair is dropped once the posterior probability of reaching the threshold is below ``TOLERANCE``.
4. The rest is verified exactly on the runs.
5. Copies are joined back: a pair of texts stands for all pairs of their samples, and samples of one text are pairs of each other.

With the defaults a pair of similarity 0.5 shares a bucket with probability 0.99, one of 0.55 with 0.999. No bucket, candidate or partner
count is capped. Buckets of at most ``PAIRED`` texts give their pairs; larger ones are compared in blocks of about ``BLOCK`` texts,
a pair of blocks per task, and only pairs that survive the pruning leave a task, so that no bucket is gathered in one place and none emits all its pairs.
Keys that hold a thousandth of the texts are found beforehand, by counts per task, and never meet in one partition.

All joins of keys and sketches are sort-merge joins (hinted, as estimates do not know what is exploded). Two tables are broadcast: the
keys of hot buckets (at most 72 · 2 / ``HOT_SHARE`` of four bytes) and the slots of the texts to verify (at most ``SLOTS`` numbers).

Defined results: nulls count as empty text; samples without any word are in no pair; a sample delivered repeatedly counts
once (earliest loaded); further columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.session import discard, written

THRESHOLD, SHINGLE = 0.5, 3
#: Bands of ROWS min-hashes each make the buckets; COMPARED further ones serve the pruning.
ROWS, BANDS, COMPARED = 4, 72, 128
HASHES = ROWS * BANDS
#: Of each compared min-hash four bits are kept, two in a byte: hashes that differ agree by chance once in 16.
CHANCE = 1 / 16
WIDTH = COMPARED // 2
STEPS = (16, 24, 32, 48, 64, 96, 128)
TOLERANCE = 1e-5
#: Texts of a bucket that give their pairs directly; texts of a block of a larger bucket.
PAIRED, BLOCK = 256, 16_384
#: Share of the texts, and least number of them, from which a bucket is hot.
HOT_SHARE, HOT_LEAST = 0.001, 2_000
#: Slots that texts to verify are marked in; one slot may stand for several texts.
SLOTS = 1 << 20
#: Conflicting 64-bit keys that may be sent along; in n texts some n² / 2⁶⁵ are expected.
CONFLICTS = 100_000
_PUNCTUATION = re.compile(r"[^\w\s]+")
_SEED = np.random.default_rng(20240607)
_MUL = (_SEED.integers(1, 1 << 31, HASHES + COMPARED, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_ADD = _SEED.integers(0, 1 << 32, HASHES + COMPARED, dtype=np.uint64).astype(np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words(instruction: str | None, response: str | None) -> list[str]:
    text = f"{instruction or ''} {response or ''}".lower()
    return _PUNCTUATION.sub("", text).split()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codes(dict):
    """64-bit codes of words, remembered per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return code


_codes = Codes()


def word_codes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


class Texts:
    """Keys and runs of many texts, worked out together: ``shingles[start[k] : start[k + 1]]`` are the sorted distinct 64-bit hashes of text k's runs."""

    def __init__(self, lists: list[list[str]], size: int = SHINGLE):
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        code = _scramble(word_codes([w for x in lists for w in x]))
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(lists)), count)
        at = (np.arange(len(code)) - begin[owner] + 1).astype(np.uint64)
        # Two 64-bit halves of a key of all words in order.
        self.one = _scramble(_sums(_scramble(code + at * _MIX[3]), begin, count))
        self.two = _scramble(_sums(_scramble(code ^ (at * _MIX[4])), begin, count))
        # A run begins at each word that has size - 1 words of its text after it; a shorter text is one run, with its length.
        total, left = np.zeros(len(code), dtype=np.uint64), count[owner] - (at.astype(np.int64) - 1)
        for k in range(size):
            ok = np.flatnonzero(left > k)
            total[ok] += code[ok + k] * _MIX[k]
        short = count[owner] < size
        total[short] += count[owner][short].astype(np.uint64)
        begins = np.flatnonzero((left >= size) | (short & (at == 1)))
        shingle, owner = _scramble(total[begins]), owner[begins]
        order = np.lexsort((shingle, owner))
        shingle, owner = shingle[order], owner[order]
        new = np.ones(len(shingle), dtype=bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        self.shingles = shingle[new]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(lists)))]).astype(np.int64)

    def runs(self, k: int) -> np.ndarray:
        return self.shingles[self.start[k] : self.start[k + 1]]

    def signatures(self) -> np.ndarray:
        out = np.empty((len(self.start) - 1, HASHES + COMPARED), dtype=np.uint32)
        for k in range(len(out)):
            signature(self.runs(k), out[k])
        return out


def _sums(x: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, modulo 2⁶⁴; 0 for an empty one."""
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x, dtype=np.uint64)])
    return upto[begin + count] - upto[begin]


_space = np.empty((128, HASHES + COMPARED), dtype=np.uint32)


def signature(shingles: np.ndarray, out: np.ndarray) -> None:
    """Min-hashes (uint32) of a non-empty set; long sets go block by block, so memory does not follow the text."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), len(_space)):
        part = low[at : at + len(_space), None]
        block = np.multiply(part, _MUL[None, :], out=_space[: len(part)])
        block += _ADD
        np.minimum.reduce(block, axis=0, out=out) if at == 0 else np.minimum(out, block.min(axis=0), out=out)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 32-bit key per text and band, of the band's number and min-hashes; a chance agreement only adds a candidate."""
    rows = sigs[:, :HASHES].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2])
    for k in range(ROWS):
        key = _scramble(key + rows[:, :, k])
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache(maxsize=None)
def least_agreements(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements in n for which P(similarity >= threshold) is not below the tolerance, under a uniform prior on the rate of agreement."""
    rate = threshold + (1 - threshold) * CHANCE
    for m in range(n + 1):
        # P(Beta(m+1, n-m+1) >= rate) is the chance of at most m successes in n+1 draws of chance rate.
        tail = sum(comb(n + 1, k) * rate**k * (1 - rate) ** (n + 1 - k) for k in range(m + 1))
        if tail >= tolerance:
            return m
    return n


def sketches(sigs: np.ndarray) -> np.ndarray:
    """The compared min-hashes, two in a byte."""
    # A least hash begins with zeros: its bits are mixed first.
    high = (sigs[:, HASHES:] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    return high[:, 0::2] << np.uint8(4) | high[:, 1::2]


def prune(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which rows of two matrices of sketches stay candidates, compared step by step."""
    alive = np.arange(len(a))
    agreed = np.zeros(len(a), dtype=np.int64)
    before = 0
    for n in STEPS:
        differ = a[alive, before // 2 : n // 2] ^ b[alive, before // 2 : n // 2]
        agreed = agreed + (differ < 16).sum(axis=1) + ((differ & 15) == 0).sum(axis=1)
        keep = agreed >= least_agreements(n, threshold, tolerance)
        alive, agreed, before = alive[keep], agreed[keep], n
    return alive


def prune_blocks(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for all pairs of two blocks of sketches (of one block, if ``same``), a few rows at a time."""
    bt = np.ascontiguousarray(b.T)
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        alive = np.ones((len(part), len(b)), dtype=bool)
        if same:
            alive = np.arange(len(b))[None, :] > np.arange(at, at + len(part))[:, None]
        agreed, before = np.zeros(alive.shape, dtype=np.uint8), 0
        for n in STEPS[:3]:
            for k in range(before // 2, n // 2):
                differ = part[:, k, None] ^ bt[None, k]
                agreed += differ < 16
                agreed += (differ & 15) == 0
            alive &= agreed >= least_agreements(n, threshold, tolerance)
            before = n
        x, y = np.nonzero(alive)
        kept = prune(part[x], b[y], threshold, tolerance)
        yield x[kept] + at, y[kept]


# --- features ----------------------------------------------------------------------------------------------------------


def _features(rows: DataFrame) -> DataFrame:
    """(id, at, one, two, n, bands, sketch) of each sample with any word: two 64-bit keys of its words, the number of its runs, min-hashes.

    The runs themselves are not kept: they are many times the size of a sketch, and few samples need them again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = [words(a, b) for a, b in zip(batch.column("instruction").to_pylist(), batch.column("response").to_pylist(), strict=True)]
                kept = [k for k, x in enumerate(lists) if x]
                texts = Texts([lists[k] for k in kept])
                sigs = texts.signatures()
                pick = pa.array(kept, pa.int64())
                keys = [pa.array(x.view(np.int64)) for x in (texts.one, texts.two)]
                columns = [batch.column("id").take(pick), batch.column("at").take(pick), *keys, pa.array(np.diff(texts.start).astype(np.int32)), _fixed(band_keys(sigs)), _fixed(sketches(sigs))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "one", "two", "n", "bands", "sketch"])

    at = rows.schema["at"].dataType.simpleString()
    return rows.select("id", "at", "instruction", "response").mapInArrow(run, f"id bigint, at {at}, one bigint, two bigint, n int, bands binary, sketch binary")


def _fixed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(matrix)
    width = data.shape[1] * data.itemsize
    ends = pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    if not len(column):
        return np.empty((0, width), dtype=kind)
    _, ends, data = column.buffers()
    begin, end = (np.frombuffer(ends, dtype=np.int32)[column.offset + k] for k in (0, len(column)))
    return np.frombuffer(data, dtype=np.uint8)[begin:end].view(kind).reshape(-1, width)


def _conflicts(features: DataFrame) -> list[int]:
    """First keys that stand for several texts; they are named by their second key."""
    twice = features.groupBy("one").agg(F.min("two").alias("lo"), F.max("two").alias("hi")).where("lo <> hi").select("one").limit(CONFLICTS + 1).collect()
    if len(twice) > CONFLICTS:
        raise ValueError("too many texts share a 64-bit key")
    return [r["one"] for r in twice]


def _named(conflicts: list[int]) -> Column:
    """The key of a row's text."""
    return F.when(F.col("one").isin(conflicts), F.col("two")).otherwise(F.col("one")) if conflicts else F.col("one")


def _members(features: DataFrame) -> DataFrame:
    """(id, at, text) of every sample, by the row that counts."""
    once = features.groupBy("id").agg(F.min(F.struct("at", "text")).alias("_r"))
    return once.select("id", F.col("_r.at").alias("at"), F.col("_r.text").alias("text"))


# --- candidates --------------------------------------------------------------------------------------------------------


def _hot_keys(features: DataFrame, texts: int) -> dict[int, int]:
    """Keys of hot buckets with a count: a key held by ``HOT_SHARE`` of all rows is among them, and at most 72 · 2 / HOT_SHARE are."""
    share, least = HOT_SHARE / 2, HOT_LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(rows), return_counts=True)
            often = count >= max(2, share * len(key) / BANDS)
            return pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(count[often].astype(np.int64))], names=["band", "count"])

        # A key that holds the share of all rows holds it in some part of a task; what the parts leave out is below half of it.
        rows, known = [], set()
        for batch in batches:
            rows.append(_matrix(batch.column("bands").take(_unseen(batch, known)), BANDS, np.int32).ravel())
            if sum(map(len, rows)) > 8_000_000:
                yield counts()
                rows = []
        if rows:
            yield counts()

    counts = features.select("text", "bands").mapInArrow(run, "band int, count bigint").groupBy("band").agg(F.sum("count").alias("count"))
    return {r["band"]: r["count"] for r in counts.where(F.col("count") >= max(least, share * texts)).collect()}


def _unseen(batch: pa.RecordBatch, known: set[int]) -> pa.Array:
    """The rows of texts that a task has not met, which it notes; so copies of a text count once per task."""
    return pa.array([k for k, t in enumerate(batch.column("text").to_pylist()) if not (t in known or known.add(t))], pa.int64())


def _band_rows(features: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(band, text) of every text and bucket that is not hot; a text that a task meets again is left out there."""
    hot_keys = np.array(sorted(hot), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                first = _unseen(batch, known)
                band = _matrix(batch.column("bands").take(first), BANDS, np.int32).ravel()
                owner = np.repeat(batch.column("text").take(first).to_numpy(), BANDS)
                if len(hot_keys):
                    cold = ~np.isin(band, hot_keys)
                    band, owner = band[cold], owner[cold]
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(owner)], names=["band", "text"])

    return features.select("text", "bands").mapInArrow(run, "band int, text bigint")


def bucket_pairs(band: np.ndarray, text: np.ndarray, paired: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of buckets of 2 to ``paired`` texts, and (band, text, size) of larger ones; rows sorted by both, whole buckets."""
    new = np.ones(len(band), dtype=bool)
    new[1:] = (band[1:] != band[:-1]) | (text[1:] != text[:-1])
    band, text = band[new], text[new]
    first = np.ones(len(band), dtype=bool)
    first[1:] = band[1:] != band[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(band)))
    sizes = np.repeat(size, size)
    left = np.repeat(begin + size, size) - np.arange(len(band)) - 1
    large = sizes > paired
    left[large] = 0
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    at, step = np.flatnonzero(left), 1
    while len(at):
        a.append(text[at])
        b.append(text[at + step])
        step += 1
        at = at[left[at] >= step]
    return (np.concatenate(a), np.concatenate(b)), (band[large], text[large], sizes[large])


def _bucketed(rows: DataFrame) -> DataFrame:
    """(a, b) of candidates, and (a, band, size) of the texts of buckets too large for pairs, from one shuffle of the band rows."""
    paired = PAIRED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(band: list[np.ndarray], text: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            (a, b), (key, member, size) = bucket_pairs(np.concatenate(band), np.concatenate(text), paired)
            for x, y, z, w in ((a, b, None, None), (member, None, key, size)):
                for at in range(0, len(x), 100_000):
                    cut = slice(at, at + 100_000)
                    n = len(x[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[cut]), pa.nulls(n, pa.int64()) if y is None else pa.array(y[cut]), pa.nulls(n, pa.int32()) if z is None else pa.array(z[cut]), pa.nulls(n, pa.int64()) if w is None else pa.array(w[cut])],
                        names=["a", "b", "band", "size"],
                    )

        band, text = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, member = batch.column("band").to_numpy(), batch.column("text").to_numpy()
            # The last bucket of a batch may go on in the next one.
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from close([*band, key[:last]], [*text, member[:last]])
                band, text = [], []
            elif band and band[-1][-1] != key[0]:
                yield from close(band, text)
                band, text = [], []
            band.append(key[last:])
            text.append(member[last:])
        if band:
            yield from close(band, text)

    return rows.repartition("band").sortWithinPartitions("band", "text").mapInArrow(run, "a bigint, b bigint, band int, size bigint")


def _blocks(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) of the pairs of large buckets that the pruning leaves. ``members``: band, size, text, n, sketch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["_i"].iloc[0]), int(frame["_j"].iloc[0])
        frame = frame.drop_duplicates("text")
        x, y = (frame[frame["_own"] == k] for k in (i, j))
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if len(x) and len(y):
            ax, by = (np.frombuffer(b"".join(f["sketch"]), dtype=np.uint8).reshape(-1, WIDTH) for f in (x, y))
            for p, q in prune_blocks(ax, by, i == j, threshold, tolerance):
                a.append(x["text"].to_numpy()[p])
                b.append(y["text"].to_numpy()[q])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = members.select("band", "text", "sketch", blocks.alias("_blocks"), F.pmod("text", blocks).cast("int").alias("_own"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cells.select("band", "text", "sketch", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    return cells.groupBy("band", "_i", "_j").applyInPandas(run, "a bigint, b bigint")


def _hot_members(features: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(band, size, text, sketch) of the texts of hot buckets."""
    keys, sizes = np.array(sorted(hot), dtype=np.int32), np.array([hot[k] for k in sorted(hot)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            first = _unseen(batch, known)
            band, first = _matrix(batch.column("bands").take(first), BANDS, np.int32).ravel(), first.to_numpy()
            at = np.flatnonzero(np.isin(band, keys))
            for lo in range(0, len(at), 50_000):
                part = at[lo : lo + 50_000]
                rows = pa.array(first[part // BANDS])
                yield pa.RecordBatch.from_arrays([pa.array(band[part]), pa.array(sizes[np.searchsorted(keys, band[part])]), batch.column("text").take(rows), batch.column("sketch").take(rows)], names=["band", "size", "text", "sketch"])

    return features.select("text", "bands", "sketch").mapInArrow(run, "band int, size bigint, text bigint, sketch binary")


def _kept(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), WIDTH, np.uint8) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).take(pa.array(prune(a, b, threshold, tolerance)))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _likely_pairs(features: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): candidates of the buckets that the pruning leaves."""
    hot = _hot_keys(features, features.count())
    found = written(_bucketed(_band_rows(features, hot)))
    candidates = found.where("b IS NOT NULL").select("a", "b").distinct()
    sketch = features.select("text", "n", "sketch").dropDuplicates(["text"])
    side = lambda c: sketch.select(F.col("text").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
    compared = candidates.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    # Sizes that differ too much cannot reach the threshold.
    compared = compared.where((F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold))
    # The smaller set of a pair is a: it is the one that travels to the other for the exact check.
    swap = F.col("n_a") > F.col("n_b")
    other = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    kept = _kept(compared.select(other("a", "b").alias("a"), other("b", "a").alias("b"), "sketch_a", "sketch_b"), threshold, tolerance)
    large = found.where("b IS NULL").select(F.col("a").alias("text"), "band", "size")
    in_blocks = []
    if hot:
        in_blocks.append(_hot_members(features, hot))
    if not large.isEmpty():
        in_blocks.append(large.hint("merge").join(sketch.hint("merge"), "text").select("band", "size", "text", "sketch"))
    for members in in_blocks:
        kept = kept.unionByName(_blocks(members, threshold, tolerance))
    if in_blocks:
        # Pairs of blocks may be candidates of small buckets as well, in either order.
        kept = kept.select("a", "b", F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).dropDuplicates(["_lo", "_hi"]).select("a", "b")
    kept = written(kept)
    discard(found)
    return kept


# --- verification ------------------------------------------------------------------------------------------------------


def _run_sets(rows: DataFrame) -> DataFrame:
    """(one, two, shingles BINARY): keys of each text, and the sorted hashes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = Texts([words(a, b) for a, b in zip(batch.column("instruction").to_pylist(), batch.column("response").to_pylist(), strict=True)])
                sets = [texts.runs(k).tobytes() for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (texts.one, texts.two)), pa.array(sets, pa.binary())], names=["one", "two", "shingles"])

    return rows.select("instruction", "response").mapInArrow(run, "one bigint, two bigint, shingles binary")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = []
            for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
                x, y = (np.frombuffer(s, dtype=np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(samples: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives with their similarity, membership (id, rep)) of ``samples``: id, at (time of loading), instruction, response.

    The representative of equal texts is the least id. Links within a text need no row: they are the membership.
    """
    named = samples.where("id IS NOT NULL")
    # One pass over the texts; from here on, only keys and sketches travel.
    features = written(_features(named))
    name = _named(_conflicts(features))
    features = features.withColumn("text", name)
    members = written(_members(features))
    # Of a sample delivered with several texts one counts; a text without a member is dropped here, with its pairs.
    reps = members.groupBy("text").agg(F.min("id").alias("rep"))
    kept = _likely_pairs(features, threshold, tolerance)
    # The texts to verify are found by slots of their ids, a table of bounded size, so that only they (and few others) are shuffled.
    needed = kept.select(F.explode(F.array("a", "b")).alias("text")).distinct().hint("merge").join(reps.hint("merge"), "text")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    few = named.withColumn("_slot", slot("id")).join(F.broadcast(needed.select(slot("rep").alias("_slot")).distinct()), "_slot", "left_semi")
    sets = _run_sets(few).select(name.alias("text"), "shingles").dropDuplicates(["text"])
    side = lambda c: sets.select(F.col("text").alias(c), F.col("shingles").alias(f"shingles_{c}")).hint("merge")
    both = kept.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    found = written(_verified(both.select("a", "b", "shingles_a", "shingles_b"), threshold))
    by = lambda c: reps.select(F.col("text").alias(c), F.col("rep").alias(f"rep_{c}")).hint("merge")
    ids = found.hint("merge").join(by("a"), "a").hint("merge").join(by("b"), "b")
    pairs = written(ids.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "similarity"))
    membership = written(members.hint("merge").join(reps.select("text", "rep").hint("merge"), "text").select("id", "rep"))
    for table in (found, kept, members, features):
        discard(table)
    return pairs, membership


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) of all near-duplicate samples, copies included; as many rows as the definition lists."""
    copies = members.groupBy("rep").count().where("count > 1").select("rep")
    group = members.hint("merge").join(copies.hint("merge"), "rep", "left_semi")
    x, y = (group.select("rep", F.col("id").alias(c)).hint("merge") for c in ("id_a", "id_b"))
    same = x.join(y, "rep").where("id_a < id_b").select("id_a", "id_b")
    a, b = members.withColumnsRenamed({"id": "ia", "rep": "a"}), members.withColumnsRenamed({"id": "ib", "rep": "b"})
    across = pairs.select("a", "b").hint("merge").join(a.hint("merge"), "a").hint("merge").join(b.hint("merge"), "b")
    return same.unionByName(across.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")))


def groups(pairs: DataFrame, members: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group_id) of every sample with a partner: connected components by alternating large- and small-star steps.

    Each step at least halves the distances that are left, so ``rounds`` serves 2^rounds links in a row; if they do not settle, it raises.
    """
    edges = written(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    size = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.hint("merge").join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.hint("merge").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small)
        # A sum of hashes over the edges tells whether a round changed anything.
        now = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        discard(edges)
        edges = after
        if size == (now["n"], now["h"]):
            break
        size = (now["n"], now["h"])
    else:
        raise RuntimeError(f"the groups have not settled in {rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    placed = members.hint("merge").join(root.hint("merge"), F.col("rep") == F.col("u"), "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    sizes = placed.groupBy("group_id").count().where("count > 1")
    return placed.hint("merge").join(sizes.hint("merge"), "group_id", "left_semi").select("id", "group_id")


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = spark.read.parquet(f"{sf_dir}/raw_samples.parquet")
    return near_duplicates(samples.select(F.col("sample_id").alias("id"), F.col("loaded_at").alias("at"), "instruction", "response"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*_found(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(*_found(spark, sf_dir)).withColumnRenamed("id", "sample_id")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rep_a, rep_b, similarity): the links between different texts, whatever the number of their copies."""
    return _found(spark, sf_dir)[0].withColumnsRenamed({"a": "rep_a", "b": "rep_b"})


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, rep, links): one row per sample with any word: its text's representative, and the number of other texts linked to it."""
    pairs, members = _found(spark, sf_dir)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.hint("merge").join(links.hint("merge"), "rep", "left").select(F.col("id").alias("sample_id"), "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


# White space as str.split sees it. In SQL all runs are joined with each other, which small tables allow.
_SPACE = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SQL = rf"""once AS (SELECT sample_id, arg_min(coalesce(instruction, '') || ' ' || coalesce(response, ''), loaded_at) AS text FROM raw_samples WHERE sample_id IS NOT NULL GROUP BY sample_id),
w AS (SELECT sample_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{_SPACE}]+', '', 'g'), '[{_SPACE}]+'), lambda x: length(x) > 0) AS w FROM once),
members AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM w WHERE len(w) > 0),
r AS (SELECT DISTINCT sample_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS run FROM w WHERE len(w) > 0),
n AS (SELECT sample_id, count(*) AS n FROM r GROUP BY sample_id),
p AS (SELECT a.sample_id AS id_a, b.sample_id AS id_b, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.sample_id < b.sample_id GROUP BY 1, 2),
found AS (SELECT id_a, id_b, shared / (x.n + y.n - shared) AS similarity FROM p JOIN n x ON x.sample_id = id_a JOIN n y ON y.sample_id = id_b WHERE 2 * shared >= x.n + y.n - shared),
pairs AS (SELECT id_a AS rep_a, id_b AS rep_b, similarity FROM found JOIN members x ON x.sample_id = id_a AND x.rep = id_a JOIN members y ON y.sample_id = id_b AND y.rep = id_b)"""
ORACLES = {
    "p4_found": f"WITH {_SQL} SELECT id_a, id_b FROM found",
    "p4_pairs": f"WITH {_SQL} SELECT * FROM pairs",
    "p4_members": f"""WITH {_SQL}, l AS (SELECT rep, count(*) AS links FROM (SELECT rep_a AS rep FROM pairs UNION ALL SELECT rep_b FROM pairs) GROUP BY rep)
SELECT sample_id, rep, coalesce(links, 0)::BIGINT AS links FROM members LEFT JOIN l USING (rep)""",
    "p4_groups": f"""WITH RECURSIVE {_SQL}, e AS (SELECT id_a AS a, id_b AS b FROM found UNION ALL SELECT id_b, id_a FROM found),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS sample_id, min(b) AS group_id FROM reach GROUP BY a""",
}
