"""Length bands from a length histogram: optimal cutoffs, elbow, feasibility, starvation guard, weights.

The histogram has at most as many rows as there are lengths up to the maximum sequence length; it is aggregated by
Spark and only then brought to the driver, after a check of its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths up to the longest sequence in use; the search is quadratic in them (some ten seconds at this bound).
MAX_LENGTHS = 1 << 16


def histogram(rows: DataFrame, limit: int) -> DataFrame:
    """(len, n) of the rows within the limit."""
    return rows.where(F.col("total_len") <= limit).groupBy(F.col("total_len").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def prefix_sums(hist: DataFrame) -> DataFrame:
    """(len, n, cum_n, cum_len): a histogram is small enough for one window."""
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("len", "n", F.sum("n").over(w).alias("cum_n"), F.sum(F.col("n") * F.col("len")).over(w).alias("cum_len"))


def pad_two_bands(hist: DataFrame) -> DataFrame:
    """(edge, padding) of every lower edge of two bands, from prefix sums."""
    p = prefix_sums(hist)
    top = p.agg(F.max("len").alias("_l"), F.max("cum_n").alias("_n"), F.max("cum_len").alias("_s"))
    pad = F.col("len") * F.col("cum_n") - F.col("cum_len") + F.col("_l") * (F.col("_n") - F.col("cum_n")) - (F.col("_s") - F.col("cum_len"))
    return p.crossJoin(F.broadcast(top)).where("len < _l").select(F.col("len").alias("edge"), pad.alias("padding"))  # one row


def to_arrays(hist: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = hist.orderBy("len").limit(MAX_LENGTHS + 1).collect()
    if len(rows) > MAX_LENGTHS:
        raise ValueError("the histogram holds more lengths than a model's sequence length allows")
    return np.array([r["len"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64)


def optimal_curve(lengths: np.ndarray, counts: np.ndarray, kmax: int) -> list[tuple[int, list[int]]]:
    """Least total padding, with the bands' upper edges, for 1 … kmax bands; of equal splits the one with the smallest edges."""
    n = len(lengths)
    if n == 0:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * c[1:] - s[1:]
    back: list[np.ndarray] = []
    out = [(int(best[-1]), [int(lengths[-1])])]
    for _ in range(1, min(kmax, n)):
        now, frm = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        for j in range(len(back) + 1, n):
            i = np.arange(len(back), j)
            cost = best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
            k = int(cost.argmin())
            now[j], frm[j] = cost[k], i[k]
        back.append(frm)
        best = now
        edges, j = [], n - 1
        for f in reversed(back):
            edges.append(int(lengths[j]))
            j = int(f[j])
        edges.append(int(lengths[j]))
        out.append((int(best[-1]), edges[::-1]))
    return out


def elbow(curve: Sequence[float], fraction: float) -> int:
    """The last k before the first whose gain falls below ``fraction`` of the padding of one band."""
    base = curve[0] or 1
    for k in range(2, len(curve) + 1):
        if (curve[k - 2] - curve[k - 1]) / base < fraction:
            return k - 1
    return len(curve)


def feasible_k(k: int, window: int, average: float, batch: int, safety: float) -> int:
    return min(k, max(1, int(window * average / (safety * batch))))


def guarded(edges: Sequence[int], lengths: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
    """Edges without starved bands: the first band below the least share joins the next one (the last joins the one before)."""
    edges, total = sorted(edges), counts.sum()
    while len(edges) > 1:
        at = np.searchsorted(lengths, edges, side="right")
        c = np.concatenate([[0], np.cumsum(counts)])
        pops = np.diff(np.concatenate([[0], c[at]]))
        starved = np.flatnonzero(pops / total < least)
        if not len(starved):
            break
        i = int(starved[0])
        del edges[i if i < len(edges) - 1 else i - 1]
    return edges


@dataclass
class BandConfig:
    k_elbow: int
    k_feasible: int
    k_final: int
    curve: dict[int, int]
    edges: list[int]
    populations: list[int]
    chunked: int
    padding_before_guard: int
    padding: int

    @property
    def cutoffs(self) -> list[int]:
        return self.edges[:-1]

    def load_cutoffs(self, edge_mode: str = "reference") -> list[int]:
        """Cutoffs for loading, where they are exclusive: as derived, or one higher, so that rows on an edge stay in their band."""
        return self.cutoffs if edge_mode == "reference" else [e + 1 for e in self.cutoffs]

    @property
    def weights(self) -> list[float]:
        total = max(1, sum(self.populations) + self.chunked)
        return [p / total for p in self.populations] + [self.chunked / total]


def derive(hist: DataFrame, chunked: int, average_shard: float, window: int = 4, batch: int = 32, kmax: int = 6, fraction: float = 0.05, least: float = 0.02, safety: float = 3.0) -> BandConfig:
    lengths, counts = to_arrays(hist)
    curve = optimal_curve(lengths, counts, kmax)
    k = elbow([c for c, _ in curve], fraction)
    kf = feasible_k(k, window, average_shard, batch, safety)
    before, edges = curve[kf - 1]
    final = guarded(edges, lengths, counts, least)
    at = np.searchsorted(lengths, final, side="right")
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    pops, sums = np.diff(np.concatenate([[0], c[at]])), np.diff(np.concatenate([[0], s[at]]))
    padding = int((np.array(final) * pops - sums).sum())
    return BandConfig(k, kf, len(final), {i + 1: p for i, (p, _) in enumerate(curve)}, final, pops.tolist(), int(chunked), before, padding)
