"""From lengths to batches: stream order, band positions, batch assignment, padding accounting, collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenforge.functions import lengths as L
from lenforge.operators.numbering import numbered
from lenforge.plans import planner


def shuffle_key(seed: str | int, key: str) -> Column:
    """The seeded stream order; the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def positioned(rows: DataFrame, key: str, seed: int = 42, groups: Sequence[str] = ("band",), first: Sequence[str] = ()) -> DataFrame:
    """Adds pos, the place of each row in its band's queue; ``first``: columns that order a queue before the shuffled order does."""
    return numbered(rows.withColumn("_key", shuffle_key(seed, key)), list(groups), [*first, "_key", key], "pos").drop("_key")


def band_counts(rows: DataFrame) -> dict[int, int]:
    """At most MAX_BANDS rows come to the driver."""
    return {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}


def scheduled(rows: DataFrame, profiles: Sequence[planner.Profile] = planner.DEFAULT_PROFILES, batch: int = 32, baseline: bool = False) -> tuple[DataFrame, planner.Plan]:
    """Rows (with band and pos) with their batch, and the plan."""
    counts = band_counts(rows)
    plan = planner.baseline_plan(counts, batch) if baseline else planner.category_plan(counts, profiles, batch)
    return planner.assign(rows, plan), plan


def batch_stats(rows: DataFrame, chunked_categories: Sequence[int], budget: int, multiple: int = 8) -> DataFrame:
    """(batch_id, category, n_rows, fell_back, width, padded_tokens, real_tokens, pad_tokens) of each batch.

    ``rows``: batch_id, category, fell_back, prompt_len, total_len. Chunked categories are windowed to the budget.
    """
    w = -(-budget // multiple) * multiple
    chunked = F.col("category").isin(list(chunked_categories)) if chunked_categories else F.lit(False)
    real = F.when(chunked, L.window_real(F.col("prompt_len"), F.col("total_len"), budget, w)).otherwise(F.col("total_len"))
    g = rows.withColumn("_real", real.cast("long")).groupBy("batch_id", "category", "fell_back")
    out = g.agg(F.count(F.lit(1)).alias("n_rows"), F.max("total_len").alias("_max"), F.sum("_real").alias("real_tokens"))
    width = F.when(chunked, F.lit(w)).otherwise(L.round_up(F.greatest(F.lit(1), F.col("_max")), multiple)).cast("long")
    out = out.withColumn("width", width).withColumn("padded_tokens", F.col("n_rows") * F.col("width"))
    return out.select("batch_id", "category", "n_rows", "fell_back", "width", "padded_tokens", "real_tokens", (F.col("padded_tokens") - F.col("real_tokens")).alias("pad_tokens"))


def batch_log(stats: DataFrame, max_pools: int | None = None) -> DataFrame:
    """The statistics with padding_pct, a row per batch; ``max_pools`` keeps the first batches (None: all)."""
    out = stats.withColumn("padding_pct", L.padding_pct(F.col("pad_tokens"), F.col("padded_tokens")))
    return out if max_pools is None else out.where(F.col("batch_id") < max_pools)


def epoch_stats(stats: DataFrame, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """One row of totals; partial sums per task, then one sum."""
    cost = L.proxy_cost(F.col("padded_tokens").cast("double"), alpha, beta, gamma)
    t = stats.agg(
        F.count(F.lit(1)).alias("pools"), F.sum("n_rows").alias("samples"), F.sum("padded_tokens").alias("padded_tokens"), F.sum("real_tokens").alias("real_tokens"),
        F.sum("pad_tokens").alias("pad_tokens"), F.count_if("fell_back").alias("fallback_pools"), F.sum(cost).alias("proxy_cost"),
    )
    return t.withColumn("padding_pct", L.padding_pct(F.col("pad_tokens"), F.col("padded_tokens"))).withColumn("useful_pct", 100.0 * L.ratio(F.col("real_tokens"), F.col("padded_tokens")))


def per_category(stats: DataFrame) -> DataFrame:
    return stats.groupBy("category").agg(F.count(F.lit(1)).alias("pools"), F.sum("padded_tokens").alias("padded_tokens"), F.sum("pad_tokens").alias("pad_tokens"))


def compare(ours: DataFrame, base: DataFrame) -> DataFrame:
    """One row: both totals and our reductions in per cent; each side is one row."""
    a, b = ours.select("padded_tokens", "proxy_cost", "padding_pct"), base.select(F.col("padded_tokens").alias("base_padded_tokens"), F.col("proxy_cost").alias("base_proxy_cost"), F.col("padding_pct").alias("base_padding_pct"))
    both = a.crossJoin(F.broadcast(b))
    cut = lambda x, y: 100.0 * L.ratio(F.col(y) - F.col(x), F.col(y))
    return both.withColumn("padded_reduction_pct", cut("padded_tokens", "base_padded_tokens")).withColumn("cost_reduction_pct", cut("proxy_cost", "base_proxy_cost"))


#: What a pool reports of its rows and of itself, where the rows have it.
ROW_COLUMNS = ("prompt_len", "context_len", "response_len", "total_len", "is_chunked", "case_code", "category", "band", "fell_back", "seq", "pos")


def collated(rows: DataFrame, multiple: int = 8, pad_id: int = 0, ignore: int = -100, window: str | None = None) -> DataFrame:
    """Padded ids, attention mask and labels per row, with the row's own lengths, flag and case.

    The batch's width is aggregated from lengths and joined back: a small table per batch that Spark sends along or meets in the one shuffle
    that brings a batch together. Pool columns that ``rows`` has (category, fell_back, band, seq) are kept.

    For chunked batches, ``window`` names the column of their budget: a row keeps its whole prompt, then context and response up to
    the budget; the width is the budget, rounded up, whatever the rows hold, and cuts a prompt that is longer.
    """
    if window is None:
        widths = rows.groupBy("batch_id").agg(L.round_up(F.greatest(F.lit(1), F.max("total_len")), multiple).alias("width"))
        at = rows.join(widths, "batch_id")
    else:
        at = rows.withColumn("width", L.round_up(F.col(window), multiple))
    zone = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    prompt, answer = zone("prompt_ids"), zone("response_ids")
    ids, before = F.concat(prompt, zone("context_ids"), answer), F.size(prompt) + F.size(zone("context_ids"))
    wide = F.col("width")
    if window is not None:
        kept = F.least(F.greatest(F.size(prompt), F.least(F.size(ids), F.col(window))), wide).cast("int")
        ids, answer, before = F.slice(ids, F.lit(1), kept), F.slice(answer, F.lit(1), F.greatest(F.lit(0), kept - before)), F.least(before, kept)
    return at.select(
        *[c for c in ("batch_id", "sample_id", "config_id", *ROW_COLUMNS, "width") if c in at.columns], L.padded_ids(ids, wide, pad_id).alias("input_ids"), L.attention_mask(F.size(ids), wide).alias("attention_mask"),
        L.labels(before, answer, wide, ignore).alias("labels"),
    )


def run_epoch(queues: DataFrame, profiles: Sequence[planner.Profile], batch: int, budget: int, baseline: bool = False, multiple: int = 8) -> tuple[DataFrame, planner.Plan]:
    """The batch statistics of one epoch over positioned rows, and its plan."""
    at, plan = scheduled(queues, profiles, batch, baseline)
    chunked = [] if baseline else [i for i, p in enumerate(profiles) if p.is_chunked]
    return batch_stats(at, chunked, budget, multiple), plan


def run_epochs(queues: DataFrame, profiles: Sequence[planner.Profile], batch: int, budget: int, multiple: int = 8, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """The category schedule against the rotation over bands; both read the same positioned table."""
    ours, base = (epoch_stats(run_epoch(queues, profiles, batch, budget, b, multiple)[0], alpha, beta, gamma) for b in (False, True))
    return compare(ours, base)


def health(plan: planner.Plan, samples: int) -> dict[str, object]:
    """Counters of a schedule: pools, pools that fell back, categories passed over, alerts by band that came short, rows streamed."""
    return {"pools": plan.batches, "fallback_pools": plan.fallbacks, "skipped_categories": plan.skipped, "empty_alerts": dict(sorted(plan.alerts.items())), "samples_streamed": samples}


# --- ranks and windows -----------------------------------------------------------------------------------------------


def assign_shards(shards: DataFrame, world: int, window: int, seed: int = 1234, epoch: int = 0) -> DataFrame:
    """(shard_id, place, rank, rank_place, resident_window): one permutation for all ranks, dealt in turn; shards are numbered over range partitions, as rows are."""
    keyed = shards.select("shard_id").distinct().withColumn("_key", F.md5(F.concat(F.lit(f"{seed}-{epoch}-"), F.col("shard_id").cast("string"))))
    out = numbered(keyed, [], ["_key", "shard_id"], "place").drop("_key")
    out = out.withColumn("rank", F.pmod("place", F.lit(world))).withColumn("rank_place", F.floor(F.col("place") / world))
    return out.withColumn("resident_window", F.floor(F.col("rank_place") / window))


def exhaustion(rows: DataFrame) -> DataFrame:
    """(rank, resident_window, band, rows, last_pos): where in the stream a band has nothing left in the window."""
    return rows.groupBy("rank", "resident_window", "band").agg(F.count(F.lit(1)).alias("n_rows"), F.max("stream_pos").alias("last_pos"))
