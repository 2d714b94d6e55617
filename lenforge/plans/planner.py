"""Batch schedules as a pure function of band counts, run-length encoded.

Queues are first-in first-out and the scheduler looks at their sizes only, so the schedule follows from the counts. While no band
runs short, every round of the categories takes the same slices; such rounds are planned as one row per slice with a
repeat count. The plan's size follows the number of times a band runs dry, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """A category: its two bands (equal for a single one), their mix, and whether it takes chunked rows."""

    bands: tuple[int, int]
    mix: tuple[float, float] = (0.5, 0.5)
    is_chunked: bool = False

    @property
    def single(self) -> bool:
        return self.is_chunked or self.bands[0] == self.bands[1]

    def target(self, batch: int) -> int:
        # Single-precision arithmetic decides the rounding.
        return min(batch, int(np.float32(np.float32(self.mix[0]) * np.float32(batch)) + np.float32(0.5)))


DEFAULT_PROFILES = (Profile((0, 1), (0.40, 0.60)), Profile((1, 2), (0.45, 0.55)), Profile((3, 3), (1.0, 0.0), True))


def profiles_from_lists(bands: Sequence[Sequence[int]], mix: Sequence[Sequence[float]] = (), chunked: Sequence[bool] = ()) -> tuple[Profile, ...]:
    return tuple(Profile((b[0], b[1]), tuple(mix[i]) if i < len(mix) else (0.5, 0.5), bool(chunked[i]) if i < len(chunked) else False) for i, b in enumerate(bands))


def single_band_profiles(n_bands: int) -> tuple[Profile, ...]:
    return tuple(Profile((b, b), (1.0, 0.0), b == n_bands - 1) for b in range(n_bands))


@dataclass
class Slice:
    """``repeats`` slices: the k-th takes rows [pos_lo + k·step, + take) of ``band`` for batch batch0 + k·stride."""

    batch0: int
    stride: int
    repeats: int
    category: int
    band: int
    seq: int
    pos_lo: int
    step: int
    take: int
    fell_back: bool = False
    alerted_band: int | None = None


@dataclass
class Plan:
    slices: list[Slice] = field(default_factory=list)
    batches: int = 0
    fallbacks: int = 0
    skipped: int = 0
    alerts: dict[int, int] = field(default_factory=dict)


def check_coverage(counts: dict[int, int], profiles: Sequence[Profile]) -> None:
    covered = {b for p in profiles for b in p.bands}
    missing = [b for b, n in counts.items() if n and b not in covered]
    if missing:
        raise ValueError(f"no category takes bands {missing}")


@dataclass
class _Batch:
    category: int
    takes: list[tuple[int, int]]
    alerted: int | None = None
    fell: bool = False


def _repeatable(start: dict[int, int], asked: dict[int, int], used: dict[int, int]) -> int:
    """How many times a round may follow itself: no band that gave something was asked for more than it had."""
    m = None
    for b, u in used.items():
        if asked[b] > u and start[b] > 0:
            return 1
        if u:
            m = start[b] // u if m is None else min(m, start[b] // u)
    return max(1, m or 1)


def _planned(counts: dict[int, int], one_round) -> Plan:
    """Runs of equal rounds; ``one_round(left, asked)`` takes its rows out of ``left`` and gives its batches, None for a skip."""
    left = {b: int(n) for b, n in sorted(counts.items())}
    at = dict.fromkeys(left, 0)
    plan, pending = Plan(), 0
    while any(left.values()):
        start, asked = dict(left), dict.fromkeys(left, 0)
        got = one_round(left, asked)
        used = {b: start[b] - left[b] for b in left}
        repeats = _repeatable(start, asked, used)
        batches = [x for x in got if x is not None]
        trailing = next(i for i, x in enumerate(reversed(got)) if x is not None)
        inside = dict.fromkeys(left, 0)
        for i, x in enumerate(batches):
            for seq, (b, t) in enumerate(x.takes):
                if t:
                    plan.slices.append(Slice(plan.batches + i, len(batches), repeats, x.category, b, seq, at[b] + inside[b], used[b], t, x.fell, x.alerted))
                    inside[b] += t
            if x.alerted is not None:
                plan.alerts[x.alerted] = plan.alerts.get(x.alerted, 0) + repeats
            plan.fallbacks += repeats * x.fell
        plan.skipped += pending + repeats * (len(got) - len(batches)) - trailing
        pending = trailing
        plan.batches += repeats * len(batches)
        for b, u in used.items():
            at[b] += u * repeats
            left[b] = start[b] - u * repeats
    return plan


def category_plan(counts: dict[int, int], profiles: Sequence[Profile], batch: int) -> Plan:
    """The round-robin category schedule: dry categories are skipped, a short band is made up for by the category's other one."""
    check_coverage(counts, profiles)
    every = dict(counts)
    for p in profiles:
        for b in p.bands:
            every.setdefault(b, 0)

    def one_round(left: dict[int, int], asked: dict[int, int]) -> list[_Batch | None]:
        out: list[_Batch | None] = []

        def take(b: int, n: int) -> int:
            asked[b] += n
            t = min(n, left[b])
            left[b] -= t
            return t

        for c, p in enumerate(profiles):
            if not any(left[b] for b in p.bands):
                out.append(None)
                continue
            if p.single:
                out.append(_Batch(c, [(p.bands[0], take(p.bands[0], batch))]))
                continue
            b0, b1 = p.bands
            t0 = p.target(batch)
            got0, got1 = take(b0, t0), take(b1, batch - t0)
            x = _Batch(c, [(b0, got0), (b1, got1)])
            rest = batch - got0 - got1
            if rest and got0 < t0 and left[b1]:
                x.alerted, x.fell = b0, True
                x.takes.append((b1, take(b1, rest)))
            elif rest and got1 < batch - t0 and left[b0]:
                x.alerted, x.fell = b1, True
                x.takes.append((b0, take(b0, rest)))
            out.append(x)
        return out

    return _planned(every, one_round)


def baseline_plan(counts: dict[int, int], batch: int) -> Plan:
    """One row per band in turn, beginning at the first band in every batch."""

    def one_round(left: dict[int, int], asked: dict[int, int]) -> list[_Batch | None]:
        taken, room = dict.fromkeys(left, 0), batch
        while room and any(left.values()):
            for b in left:
                if room and left[b]:
                    left[b] -= 1
                    taken[b] += 1
                    room -= 1
        for b, t in taken.items():
            # A band that ran dry in the round was asked for more than it had.
            asked[b] = t + (left[b] == 0)
        return [_Batch(-1, list(taken.items()))]

    return _planned(counts, one_round)


SLICE_SCHEMA = "batch0 bigint, stride bigint, repeats bigint, category int, band int, seq int, pos_lo bigint, step bigint, take bigint, fell_back boolean, alerted_band int"


def plan_table(spark: SparkSession, plan: Plan) -> DataFrame:
    rows = [tuple(getattr(s, c.split()[0]) for c in SLICE_SCHEMA.split(", ")) for s in plan.slices]
    return spark.createDataFrame(rows, SLICE_SCHEMA)


def expanded(plan: DataFrame) -> DataFrame:
    """(batch_id, category, band, seq, pos_lo, pos_hi, fell_back): one row per slice of a batch."""
    k = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("_k"))
    lo = F.col("pos_lo") + F.when(F.col("repeats") > 1, F.col("_k") * F.col("step")).otherwise(0)
    return k.select((F.col("batch0") + F.col("_k") * F.col("stride")).alias("batch_id"), "category", "band", "seq", lo.alias("pos_lo"), (lo + F.col("take")).alias("pos_hi"), "fell_back")


def assign(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds batch_id, category, seq and fell_back to rows with band and pos: a join with the run-length plan, of a bounded size."""
    if len(plan.slices) > 100_000:
        raise ValueError("the plan is not run-length encoded")
    p = plan_table(rows.sparkSession, plan).withColumnRenamed("band", "_band")
    off = F.col("pos") - F.col("pos_lo")
    inside = (F.col("band") == F.col("_band")) & (off >= 0)
    k = F.when(F.col("repeats") > 1, F.floor(off / F.col("step"))).otherwise(F.lit(0))
    within = off - F.when(F.col("repeats") > 1, k * F.col("step")).otherwise(F.lit(0))
    joined = rows.join(F.broadcast(p), inside & (k < F.col("repeats")) & (within < F.col("take")))
    return joined.select(*rows.columns, (F.col("batch0") + k * F.col("stride")).alias("batch_id"), "category", "seq", "fell_back")

