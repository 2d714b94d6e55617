"""Cost model: medians of repeats, least squares, epoch estimates, telemetry."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenforge.functions import lengths as L


def medians(runs: DataFrame) -> DataFrame:
    """(rows, width, seconds) with the median of the repeats."""
    return runs.groupBy("n_rows", "width").agg(F.percentile("seconds", F.lit(0.5)).alias("seconds"))


def fit(points: DataFrame) -> DataFrame:
    """(d, a, c, max_residual) of seconds = d + a·BT + c·BT², by normal equations from one aggregation."""
    x1, x2 = F.col("n_rows").cast("double") * F.col("width"), F.col("n_rows").cast("double") * F.col("width") * F.col("width")
    # Scaled to the order of one, so that the determinant keeps its digits.
    p = points.select((x1 / 1e4).alias("x"), (x2 / 1e7).alias("z"), F.col("seconds").alias("y"))
    s = p.agg(*(F.sum(e).alias(n) for n, e in {"n": F.lit(1.0), "sx": F.col("x"), "sz": F.col("z"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "xz": F.col("x") * F.col("z"), "zz": F.col("z") * F.col("z"), "xy": F.col("x") * F.col("y"), "zy": F.col("z") * F.col("y")}.items()))
    det = "(n*(xx*zz-xz*xz) - sx*(sx*zz-xz*sz) + sz*(sx*xz-xx*sz))"
    d = f"(sy*(xx*zz-xz*xz) - sx*(xy*zz-xz*zy) + sz*(xy*xz-xx*zy)) / {det}"
    a = f"(n*(xy*zz-xz*zy) - sy*(sx*zz-xz*sz) + sz*(sx*zy-xy*sz)) / {det} / 1e4"
    c = f"(n*(xx*zy-xy*xz) - sx*(sx*zy-xy*sz) + sy*(sx*xz-xx*sz)) / {det} / 1e7"
    model = s.where(f"{det} <> 0").select(F.expr(d).alias("d"), F.expr(a).alias("a"), F.expr(c).alias("c"))
    gap = F.abs(F.col("seconds") - L.step_seconds(F.col("n_rows"), F.col("width"), F.col("a"), F.col("c"), F.col("d")))
    return points.crossJoin(F.broadcast(model)).groupBy("d", "a", "c").agg(F.max(gap).alias("max_residual"))  # one row


def epoch_hours(stats: DataFrame, a: float, c: float, d: float) -> DataFrame:
    return stats.agg((F.sum(L.step_seconds(F.col("n_rows"), F.col("width"), a, c, d)) / 3600.0).alias("hours"))


class Phases:
    """Totals and means of named phases of wall-clock time around Spark actions."""

    def __init__(self) -> None:
        self.total: dict[str, float] = {}
        self.count: dict[str, int] = {}
        self.began = time.perf_counter()

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        t = time.perf_counter()
        try:
            yield
        finally:
            self.total[name] = self.total.get(name, 0.0) + time.perf_counter() - t
            self.count[name] = self.count.get(name, 0) + 1

    def summary(self) -> dict[str, dict[str, float]]:
        wall = time.perf_counter() - self.began
        return {k: {"total_s": v, "mean_ms": 1000 * v / self.count[k] if self.count[k] else 0.0, "pct_of_wall": 100 * v / wall if wall else 0.0} for k, v in self.total.items()}


def overlap_pct(formation: float, stall: float) -> float:
    """Share of the formation time hidden behind other work."""
    return 100.0 * (1 - min(stall, formation) / formation) if formation else 0.0


def train_efficiency(train: float, wait: float) -> float:
    return train / (train + wait) if train + wait else 0.0
