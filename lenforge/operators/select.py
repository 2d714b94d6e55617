"""Selection of samples by utility and diversity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lenforge.session import written


@dataclass(frozen=True)
class SelectConfig:
    top: int = 32
    alpha: float = 1.0
    capacity: int = 1024
    project_to: int = 256
    stage_one: int = 128
    stage_two: int = 8
    warm_up: int = 100
    seed: int = 1234


def projection(dim_in: int, dim_out: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim_in, dim_out)) / np.sqrt(dim_out)


def fast_jl(rows: DataFrame, key: str, vector: str, dim: int, cfg: SelectConfig = SelectConfig()) -> DataFrame:
    """(key, z): two Gaussian projections, one after the other; Arrow batches, no shuffle."""
    both = projection(dim, cfg.stage_one, cfg.seed) @ projection(cfg.stage_one, cfg.stage_two, cfg.seed + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({key: f[key], "z": list(np.stack(f[vector].to_numpy()).astype(float) @ both)})

    return rows.where(F.size(vector) == dim).select(key, vector).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, z array<double>")


def nuclear_norm(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, s_intra): the sum of singular values of each group's rows; a group is one pool item, of bounded length."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(f[vector].to_numpy()).astype(float)
        return pd.DataFrame({group: [f[group].iloc[0]], "s_intra": [float(np.linalg.svd(m, compute_uv=False).sum())]})

    return rows.select(group, vector).groupBy(group).applyInPandas(run, f"{group} {rows.schema[group].dataType.simpleString()}, s_intra double")


def item_scores(rows: DataFrame, key: str, pos: str, vector: str, mask: str, dim: int, cfg: SelectConfig = SelectConfig()) -> DataFrame:
    """(key, s_intra, z) of pool items given as rows (key, pos, vector, mask): the nuclear norm of the projected unmasked rows, and the projected mean of them."""
    wide, both = projection(dim, cfg.project_to, cfg.seed + 1), projection(dim, cfg.stage_one, cfg.seed) @ projection(cfg.stage_one, cfg.stage_two, cfg.seed + 1)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(pos)
        m = np.stack(f[vector].to_numpy()).astype(float) * f[mask].to_numpy(dtype=float)[:, None]
        mean = m.sum(axis=0) / max(1.0, float(f[mask].sum()))
        return pd.DataFrame({key: [f[key].iloc[0]], "s_intra": [float(np.linalg.svd(m @ wide, compute_uv=False).sum())], "z": [mean @ both]})

    kept = rows.where(F.size(vector) == dim).select(key, pos, vector, F.coalesce(F.col(mask).cast("int"), F.lit(0)).alias(mask))
    return kept.groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, s_intra double, z array<double>")


def z_scores(x: np.ndarray) -> np.ndarray:
    """``z_norm`` of one pool."""
    return (x - x.mean()) / max(float(x.std(ddof=1)) if len(x) > 1 else 0.0, 1e-6)


def choose_step(pools: dict[int, tuple[np.ndarray, np.ndarray]], held: dict[int, np.ndarray], cfg: SelectConfig, shared: bool) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By rank: (chosen places, s_inter, score) of one step's pools (s_intra, z), in key order; ``held`` gives each rank's buffer."""
    out, scores = {}, {}
    for rank, (intra, z) in pools.items():
        b = held[rank]
        inter = np.array([np.sqrt(((b - v) ** 2).sum(axis=1)).mean() for v in z]) if len(b) else np.zeros(len(z))
        scores[rank] = inter, z_scores(intra) + cfg.alpha * z_scores(inter)
    every = np.sort(np.concatenate([s for _, s in scores.values()]))
    least = every[-min(cfg.top * len(pools), len(every))] if shared else -np.inf
    for rank, (inter, score) in scores.items():
        best = np.argsort(-score, kind="stable")
        out[rank] = np.sort(best[score[best] >= least][: cfg.top]), inter, score
    return out


def select_pools(items: DataFrame, step: str, rank: str, key: str, shared: bool, cfg: SelectConfig = SelectConfig()) -> DataFrame:
    """(step, rank, key, s_inter, score) of the items (step, rank, key, s_intra, z) to train on.

    Before step ``warm_up`` the whole pool, without scores. After that the best ``top`` of each rank by the sum of both z-norms,
    with ``shared`` only those not below the top·ranks-th best score of the step; they go into the buffer, which all ranks then share.
    Each step needs the buffer of the one before: one task reads the items in their order and holds one step and the buffer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[int, np.ndarray] = {}

        def close(at: int, rows: list[tuple]) -> pa.RecordBatch:
            ranks = sorted({r[0] for r in rows})
            if at < cfg.warm_up:
                out = [(at, r[0], r[1], None, None) for r in rows]
            else:
                mine = {k: [r for r in rows if r[0] == k] for k in ranks}
                pools = {k: (np.array([r[2] for r in v]), np.array([r[3] for r in v])) for k, v in mine.items()}
                none = np.empty((0, cfg.stage_two))
                held = {k: buffers.get(-1 if shared else k, none) for k in ranks}
                out = []
                for k, (chosen, inter, score) in choose_step(pools, held, cfg, shared).items():
                    out += [(at, k, mine[k][i][1], float(inter[i]), float(score[i])) for i in chosen]
                    name = -1 if shared else k
                    buffers[name] = np.concatenate([buffers.get(name, none), pools[k][1][chosen]])[-cfg.capacity :]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

        at, rows = None, []
        for batch in batches:
            for s, *r in zip(*(batch.column(c).to_pylist() for c in ("step", "rank", "key", "s_intra", "z")), strict=True):
                if s != at and rows:
                    yield close(at, rows)
                    rows = []
                at = s
                rows.append(tuple(r))
        if rows:
            yield close(at, rows)

    schema = pa.schema([("step", pa.int64()), ("rank", pa.int64()), ("key", pa.int64()), ("s_inter", pa.float64()), ("score", pa.float64())])
    rows = items.select(*(F.col(c).cast("long").alias(n) for c, n in ((step, "step"), (rank, "rank"), (key, "key"))), "s_intra", "z")
    ordered = rows.repartition(1).sortWithinPartitions("step", "rank", "key")
    out = ordered.mapInArrow(run, "step bigint, rank bigint, key bigint, s_inter double, score double")
    return out.select(F.col("step").alias(step), F.col("rank").alias(rank), F.col("key").alias(key), "s_inter", "score")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def last(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """The buffer: the last rows by their sequence, a bounded number."""
    return rows.orderBy(F.col(order).desc()).limit(capacity)


def diversity(rows: DataFrame, key: str, vector: str, buffer: DataFrame, buffer_vector: str, capacity: int = 1024) -> DataFrame:
    """(key, s_inter): mean distance to the buffer, 0 for an empty one. The buffer's size is fixed, so it travels as one array."""
    held = buffer.limit(capacity).agg(F.collect_list(buffer_vector).alias("_buffer"))
    total = F.aggregate("_buffer", F.lit(0.0), lambda s, b: s + distance(F.col(vector), b))
    out = rows.crossJoin(F.broadcast(held))  # one row
    return out.select(key, F.when(F.size("_buffer") > 0, total / F.size("_buffer")).otherwise(F.lit(0.0)).alias("s_inter"))


def z_norm(rows: DataFrame, col: str, pool: str, name: str) -> DataFrame:
    """Adds ``name``: centred and scaled by the pool's sample deviation, at least 1e-6; a pool of one scores 0.

    Mean and deviation are aggregated map-side, a row per pool, and joined back, so that a hot pool is no single task.
    """
    kept = written(rows)
    of_pool = kept.groupBy(F.col(pool).alias("_pool")).agg(F.avg(col).alias("_mean"), F.greatest(F.coalesce(F.stddev_samp(col), F.lit(0.0)), F.lit(1e-6)).alias("_spread"))
    joined = kept.join(of_pool, F.col(pool).eqNullSafe(F.col("_pool")))
    return joined.select(*rows.columns, ((F.col(col) - F.col("_mean")) / F.col("_spread")).alias(name))


def top_local(rows: DataFrame, pool: str, score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(pool).orderBy(F.col(score).desc(), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_global(rows: DataFrame, rank: str, score: str, key: str, k: int, world: int) -> DataFrame:
    """Rows not below the k·world-th best score; of a rank with more than k of them, its best k."""
    threshold = rows.orderBy(F.col(score).desc()).limit(k * world).agg(F.min(score).alias("_t"))
    return top_local(rows.crossJoin(F.broadcast(threshold)).where(F.col(score) >= F.col("_t")).drop("_t"), rank, score, key, k)  # one row


def masked_mean(rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """(key, mean) of the vectors of unmasked positions, per dimension."""
    kept = rows.where(F.col(mask) == 1).select(key, F.posexplode(vector).alias("_d", "_v"))
    means = kept.groupBy(key, "_d").agg(F.avg("_v").alias("_m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("mean"))


def commit(buffer: DataFrame, chosen: DataFrame, capacity: int) -> DataFrame:
    """The buffer with the chosen rows, keyed by (step, rank, key) so that a repeated merge changes nothing; the newest stay."""
    both = buffer.unionByName(chosen).dropDuplicates(["step", "rank", "key"])
    return both.orderBy(F.col("step").desc(), F.col("rank").desc(), F.col("key").desc()).limit(capacity)
