"""The pipeline as one object: shards to collated pools, with the counters of its schedule; an epoch report; a loop without training."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.functions import lengths as L
from lenforge.operators import batches
from lenforge.operators.numbering import numbered
from lenforge.plans import planner


@dataclass
class PipelineConfig:
    """Settings of a pipeline. ``max_queue_occupancy``, ``prefetch_workers`` and ``ring_capacity`` are accepted: Spark's stages and its prefetching iterator take their part."""

    shards: str = ""
    rank: int = 0
    world_size: int = 1
    seed: int = 1234
    num_epochs: int = -1
    max_queue_occupancy: int = 50_000
    B: int = 64
    profile_bands: list[list[int]] = field(default_factory=list)
    profile_mix: list[list[float]] = field(default_factory=list)
    profile_is_chunked: list[bool] = field(default_factory=list)
    baseline: bool = False
    resident_window: int = 4
    band_cutoffs: list[int] = field(default_factory=lambda: [512, 1536])
    band_max_seq_len: int = 2048
    pad_id: int = 0
    ignore_index: int = -100
    option_b_window: int = 2048
    pad_to_multiple: int = 8
    prefetch_workers: int = 2
    ring_capacity: int = 3

    def profiles(self) -> tuple[planner.Profile, ...]:
        if self.profile_bands:
            return planner.profiles_from_lists(self.profile_bands, self.profile_mix, self.profile_is_chunked)
        return planner.DEFAULT_PROFILES


@dataclass
class CollatedPool:
    """One batch: matrices of int64, counts, and what its rows were before padding."""

    input_ids: np.ndarray
    attention_mask: np.ndarray
    labels: np.ndarray
    is_chunked: bool
    band: int
    profile_index: int
    mixed: bool
    fell_back: bool
    baseline: bool
    batch_size: int
    padded_width: int
    padded_tokens: int
    real_tokens: int
    pad_tokens: int
    prompt_len: list[int]
    context_len: list[int]
    response_len: list[int]
    is_chunked_flags: list[int]
    case_codes: list[int]
    formation_seconds: float = 0.0

    def __len__(self) -> int:
        return self.batch_size


def stream_order(rows: DataFrame, cfg: PipelineConfig, epoch: int) -> DataFrame:
    """The rank's rows with their band at loading and pos, the place in the band's queue: shard windows in turn, shuffled inside."""
    at = batches.assign_shards(rows, cfg.world_size, cfg.resident_window, cfg.seed, epoch).where(F.col("rank") == cfg.rank)
    band = L.band_at_load(F.col("total_len"), F.col("is_chunked") == 1, cfg.band_cutoffs, cfg.band_max_seq_len)
    key = F.md5(F.concat_ws("-", F.lit(f"{cfg.seed}-{cfg.rank}-{epoch}"), F.col("shard_id").cast("string"), F.col("sample_idx").cast("string")))
    mine = rows.join(at.select("shard_id", "resident_window"), "shard_id").withColumn("band", band).withColumn("_key", key)
    # Only keys and lengths are sorted; ids are joined back where a pool is collated.
    thin = mine.select("shard_id", "sample_idx", "band", "resident_window", "_key", "prompt_len", "context_len", "response_len", "total_len", "is_chunked", "case_code")
    return numbered(thin, ["band"], ["resident_window", "_key", "shard_id", "sample_idx"], "pos").drop("_key")


class DataPipeline:
    """``start``, then ``next_pool`` until None. Each epoch is planned from its queue sizes; with num_epochs of -1 epochs follow without end."""

    def __init__(self, spark: SparkSession, cfg: PipelineConfig):
        self.spark, self.cfg, self.profiles = spark, cfg, cfg.profiles()
        self._pools: Iterator[CollatedPool] | None = None
        self._done = False
        self._formed, self._form_s, self._stall_s, self._streamed, self._left = 0, 0.0, 0.0, 0, 0
        self._alerts: dict[int, int] = {}
        self._fallbacks = self._skipped = 0

    def start(self) -> None:
        self._pools, self._done = self._run(), False

    def stop(self) -> None:
        self._pools, self._done = None, True

    def queues(self, epoch: int = 0) -> DataFrame:
        return stream_order(self.spark.read.parquet(self.cfg.shards).drop("folder"), self.cfg, epoch)

    def collated(self, epoch: int = 0) -> tuple[DataFrame, planner.Plan]:
        """A row per row of a pool, in no order, and the plan."""
        cfg = self.cfg
        at, plan = batches.scheduled(self.queues(epoch), self.profiles, cfg.B, cfg.baseline)
        ids = self.spark.read.parquet(cfg.shards).select("shard_id", "sample_idx", "prompt_ids", "context_ids", "response_ids")
        rows = at.join(ids, ["shard_id", "sample_idx"])
        chunked = [] if cfg.baseline else [i for i, p in enumerate(self.profiles) if p.is_chunked]
        is_chunked = F.col("category").isin(chunked) if chunked else F.lit(False)
        fit = batches.collated(rows.where(~is_chunked), cfg.pad_to_multiple, cfg.pad_id, cfg.ignore_index)
        cut = batches.collated(rows.where(is_chunked).withColumn("_budget", F.lit(cfg.option_b_window)), cfg.pad_to_multiple, cfg.pad_id, cfg.ignore_index, "_budget")
        return fit.unionByName(cut), plan

    def _run(self) -> Iterator[CollatedPool]:
        epoch = 0
        while self.cfg.num_epochs < 0 or epoch < self.cfg.num_epochs:
            began = time.perf_counter()
            rows, plan = self.collated(epoch)
            self._left = sum(s.take * s.repeats for s in plan.slices)
            if not self._left:
                return
            for b, n in plan.alerts.items():
                self._alerts[b] = self._alerts.get(b, 0) + n
            self._fallbacks += plan.fallbacks
            self._skipped += plan.skipped
            ordered = rows.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "seq", "pos")
            for _, group in groupby(ordered.toLocalIterator(prefetchPartitions=True), key=lambda r: r["batch_id"]):
                pool = self._pool(list(group))
                pool.formation_seconds = time.perf_counter() - began
                self._form_s += pool.formation_seconds
                self._formed += 1
                self._streamed += len(pool)
                self._left -= len(pool)
                yield pool
                began = time.perf_counter()
            epoch += 1

    def _pool(self, rows: list) -> CollatedPool:
        first = rows[0]
        stacked = lambda c: np.array([r[c] for r in rows], dtype=np.int64)
        ids, mask, labels = stacked("input_ids"), stacked("attention_mask"), stacked("labels")
        real, profile = int(mask.sum()), first["category"]
        of = self.profiles[profile] if profile >= 0 else None
        chunked = bool(of and of.is_chunked)
        each = lambda c: [int(r[c]) for r in rows]
        return CollatedPool(
            ids, mask, labels, chunked, L.n_bands(self.cfg.band_cutoffs) - 1 if chunked else of.bands[0] if of else first["band"], profile, of is None or not of.single, bool(first["fell_back"]), of is None,
            len(rows), ids.shape[1], ids.size, real, ids.size - real, each("prompt_len"), each("context_len"), each("response_len"), each("is_chunked"), each("case_code"),
        )

    def next_pool(self) -> CollatedPool | None:
        began = time.perf_counter()
        pool = next(self._pools, None) if self._pools is not None else None
        self._stall_s += time.perf_counter() - began
        self._done = self._done or pool is None
        return pool

    def formation_total_s(self) -> float:
        return self._form_s

    def formation_mean_ms(self) -> float:
        return 1000 * self._form_s / self._formed if self._formed else 0.0

    def formation_count(self) -> int:
        return self._formed

    def stall_total_s(self) -> float:
        return self._stall_s

    def stall_mean_ms(self) -> float:
        return 1000 * self._stall_s / self._formed if self._formed else 0.0

    def samples_streamed(self) -> int:
        return self._streamed

    def queue_size(self) -> int:
        return self._left

    def empty_alerts(self) -> list[int]:
        return [self._alerts.get(b, 0) for b in range(L.n_bands(self.cfg.band_cutoffs))]

    def fallback_pools(self) -> int:
        return self._fallbacks

    def skipped_categories(self) -> int:
        return self._skipped

    def streamer_done(self) -> bool:
        return self._done


def epoch_report(pipe: DataPipeline, method: str, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0, max_pools: int | None = None) -> dict:
    """Totals, health and categories of one epoch of a rank, from lengths alone: no id is read."""
    began, cfg = time.perf_counter(), pipe.cfg
    queues = pipe.queues()
    stats, plan = batches.run_epoch(queues, pipe.profiles, cfg.B, cfg.option_b_window, cfg.baseline, cfg.pad_to_multiple)
    stats = batches.batch_log(stats, max_pools)
    total = batches.epoch_stats(stats, alpha, beta, gamma).first().asDict()
    samples = total["samples"] or 0
    by = {f"CAT{r['category']}": {"pools": r["pools"], "padded_tokens": r["padded_tokens"], "pad_tokens": r["pad_tokens"], "padding_pct": round(100 * r["pad_tokens"] / r["padded_tokens"], 2) if r["padded_tokens"] else 0.0} for r in batches.per_category(stats).orderBy("category").collect()}
    whole = {k: total[k] or 0 for k in ("pools", "samples", "padded_tokens", "real_tokens", "pad_tokens")}
    shares = {k: round(total[k] or 0.0, 2) for k in ("padding_pct", "useful_pct")}
    counters = {k: v for k, v in batches.health(plan, samples).items() if k != "pools"}
    return {"method": method, **whole, **shares, "proxy_time": round(total["proxy_cost"] or 0.0, 2), "wall_seconds": round(time.perf_counter() - began, 3), **counters, "per_category": by}


#: Counters of a rank's report that ranks add up.
SUMMED = ("pools", "samples", "padded_tokens", "real_tokens", "pad_tokens", "proxy_time", "fallback_pools", "skipped_categories", "samples_streamed")


def summed(reports: list[dict]) -> dict:
    """The nine counters over all ranks, and the shares that follow."""
    out = {k: sum(r[k] for r in reports) for k in SUMMED}
    pct = 100 * out["pad_tokens"] / out["padded_tokens"] if out["padded_tokens"] else 0.0
    return {**out, "padding_pct": round(pct, 2), "useful_pct": round(100 - pct, 2)}


def run_loader_only(pipe: DataPipeline, sim_step_s: float = 0.0, max_batches: int | None = None) -> tuple[dict, list[dict]]:
    """Takes every pool of a started pipeline, with a pause in place of a training step: (totals and throughput, a row per batch)."""
    began, waited, paused, rows = time.perf_counter(), 0.0, 0.0, []
    while max_batches is None or len(rows) < max_batches:
        t = time.perf_counter()
        pool = pipe.next_pool()
        waited += time.perf_counter() - t
        if pool is None:
            break
        rows.append({"batch": len(rows), "profile": pool.profile_index, "batch_size": len(pool), "padded_width": pool.padded_width, "padded_tokens": pool.padded_tokens, "real_tokens": pool.real_tokens, "pad_tokens": pool.pad_tokens, "padding_pct": 100.0 * pool.pad_tokens / pool.padded_tokens if pool.padded_tokens else 0.0, "fell_back": pool.fell_back})
        if sim_step_s:
            time.sleep(sim_step_s)
            paused += sim_step_s
    wall = time.perf_counter() - began
    loading = wall - paused
    total = {k: sum(r[k] for r in rows) for k in ("padded_tokens", "real_tokens", "pad_tokens")}
    samples = sum(r["batch_size"] for r in rows)
    rate = lambda n: n / loading if loading > 0 else 0.0
    return {
        "batches": len(rows), "samples": samples, **total, "padding_pct": 100.0 * total["pad_tokens"] / total["padded_tokens"] if total["padded_tokens"] else 0.0, "wall_seconds": wall, "sim_step_seconds_total": paused, "loader_wall_seconds": loading, "measured_wait_seconds": waited,
        "batches_per_sec": rate(len(rows)), "samples_per_sec": rate(samples), "tokens_per_sec": rate(total["real_tokens"]), "formation_total_s": pipe.formation_total_s(), "stall_total_s": pipe.stall_total_s(), "fallback_pools": pipe.fallback_pools(), "skipped_categories": pipe.skipped_categories(), "samples_streamed": pipe.samples_streamed(),
    }, rows
