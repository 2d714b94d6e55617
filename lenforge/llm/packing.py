"""Problem 5: filling containers of fixed capacity with whole items, by the sum-of-squares rule.

For each residual gap the number of open containers with that gap is kept; an item goes where the sum of the squared
counts becomes smallest. Items of a capacity are dealt by a hash of their key into groups of at most about ``GROUP_ITEMS``
that are packed side by side, so that a hot capacity spreads over the cluster; a group ends with a few open containers only.

Defined results: an item that is null or negative in size is not measured and left out; an item of size 0 joins a container
without using space; an item above the capacity fills containers of its own, and its remainder is packed like an item, as its last
part; rows repeated under a key count once (the earliest loaded); rows of unknown config are left out. Ties go to the smallest gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ITEMS = 50_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, items taken in the order given."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    last = None
    for k, size in enumerate(sizes.tolist()):
        if size == 0:
            if last is None:
                last, made = made, made + 1
                counts[capacity] += 1
                open_at[capacity].append(last)
            out[k] = last
            continue
        # Change of the sum over 2, apart from a constant: counts[gap - size] - counts[gap] + 1; a full container counts nothing.
        change = counts[: capacity - size + 1] - counts[size:]
        change = np.where(counts[size:] > 0, change, 1 << 40)
        best = int(change.argmin())
        # A new container takes the place of an empty one: counts[capacity - size] + 1/2 against change + 1.
        fresh = counts[capacity - size] if size < capacity else -1
        if change[best] < (1 << 40) and (best == 0 or change[best] + 1 <= fresh):
            gap = best + size
            at = open_at[gap].pop()
            counts[gap] -= 1
        else:
            at, made = made, made + 1
            gap = capacity
        gap -= size
        if gap:
            counts[gap] += 1
            open_at[gap].append(at)
        out[k] = at
        last = at
    return out


def pack(items: DataFrame, capacities: DataFrame, key: str, size: str, by: str, capacity: str, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(by, key, part_no, part_size, container_id, capacity) of each item; container_id is unique within ``by``."""
    measured = items.where((F.col(size) >= 0) & F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(key).alias("key"), F.col(size).cast("long").alias("size"))
    caps = capacities.where(F.col(capacity) >= 1).select(F.col(by).alias("by"), F.col(capacity).cast("long").alias("cap")).groupBy("by").agg(F.min("cap").alias("cap"))
    groups = measured.groupBy("by").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_items)).alias("groups"))
    rows = measured.join(caps.join(groups, "by"), "by").withColumn("grp", F.pmod(F.xxhash64("key"), F.col("groups")))
    whole = F.when(F.col("size") > F.col("cap"), F.floor(F.col("size") / F.col("cap"))).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole).withColumn("rest", F.col("size") - F.col("whole") * F.col("cap"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large items first, so that small ones close the gaps; keys break ties, so that a repeated run gives the same.
        pdf = pdf.sort_values(["rest", "key"], ascending=[False, True], kind="stable")
        packed = pdf[(pdf["rest"] > 0) | (pdf["whole"] == 0)]
        where = sum_of_squares(packed["rest"].to_numpy(), int(pdf["cap"].iloc[0]))
        used = int(where.max()) + 1 if len(where) else 0
        first = pd.DataFrame({"by": packed["by"], "key": packed["key"], "part_no": packed["whole"], "part_size": packed["rest"], "slot": where})
        long = pdf[pdf["whole"] > 0]
        times = long["whole"].to_numpy()
        part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, dtype=np.int64)
        over = long.loc[long.index.repeat(times)]
        second = pd.DataFrame({"by": over["by"].to_numpy(), "key": over["key"].to_numpy(), "part_no": part, "part_size": over["cap"].to_numpy(), "slot": used + np.arange(len(part))})
        out = pd.concat([first, second], ignore_index=True)
        # Groups are interleaved: slot * groups + group is unique.
        out["container_id"] = out["slot"] * int(pdf["groups"].iloc[0]) + int(pdf["grp"].iloc[0])
        out["capacity"] = int(pdf["cap"].iloc[0])
        return out[["by", "key", "part_no", "part_size", "container_id", "capacity"]]

    kinds = {c: items.schema[c].dataType.simpleString() for c in (by, key)}
    schema = f"by {kinds[by]}, key {kinds[key]}, part_no bigint, part_size bigint, container_id bigint, capacity bigint"
    # A fixed number of partitions: groups are small in bytes but long to pack, and must not be merged into few tasks.
    spark = items.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    packed = rows.repartition(n, "by", "grp").groupBy("by", "grp").applyInPandas(run, schema)
    return packed.select(F.col("by").alias(by), F.col("key").alias(key), "part_no", "part_size", "container_id", "capacity")


def measured_once(lengths: DataFrame) -> DataFrame:
    """(sample_id, config_id, total_len), each measured pair once."""
    rows = lengths.where(F.col("total_len") >= 0)
    return rows.groupBy("sample_id", "config_id").agg(F.min(F.struct("loaded_at", "total_len")).alias("_r")).select("sample_id", "config_id", F.col("_r.total_len").alias("total_len"))


def p5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spark.read.parquet(f"{sf_dir}/token_lengths.parquet")
    config = spark.read.parquet(f"{sf_dir}/build_config.parquet")
    return pack(measured_once(lengths), config, "sample_id", "total_len", "config_id", "max_seq_length")


def p5_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, used and unused ids per config."""
    boxes = p5_packing(spark, sf_dir).groupBy("config_id", "container_id", "capacity").agg(F.sum("part_size").alias("used"))
    out = boxes.groupBy("config_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used_ids"), F.sum(F.col("capacity") - F.col("used")).alias("unused_ids"), F.max(F.col("used") - F.col("capacity")).alias("worst_excess"))
    return out.withColumn("unused_share", F.col("unused_ids") / (F.col("used_ids") + F.col("unused_ids")))


def p5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep, per config: each measured item once and with its whole size, in more than one container only if above the capacity, no container above it."""
    boxes = p5_packing(spark, sf_dir)
    items = boxes.groupBy("config_id", "sample_id", "capacity").agg(F.sum("part_size").alias("size"), F.count(F.lit(1)).alias("parts"))
    torn = F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity")))
    kept = items.groupBy("config_id").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used_ids"), torn.alias("torn_items"))
    over = boxes.groupBy("config_id", "container_id", "capacity").agg(F.sum("part_size").alias("used")).groupBy("config_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return kept.join(over, "config_id")


ORACLES = {
    "p5_whole": """
SELECT config_id, count(*)::BIGINT AS items, sum(total_len)::BIGINT AS used_ids, 0::BIGINT AS torn_items, 0::BIGINT AS overfull
FROM (SELECT sample_id, config_id, arg_min(total_len, loaded_at) AS total_len FROM token_lengths WHERE total_len >= 0 GROUP BY ALL)
JOIN build_config USING (config_id) GROUP BY config_id
"""
}
