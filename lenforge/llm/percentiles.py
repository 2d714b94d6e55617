"""Problem 2: exact percentiles per group of very large numeric columns, from states that combine.

``keyed_state`` holds each measurement once under its key, with its time of loading, so states of separate days or files combine by
``combine_states`` even if a row was delivered in several of them: the earliest one counts, as in one state of all rows. ``counted_state``
is the smaller form (a count per distinct value), to be used where a key cannot occur in two parts. Either gives the percentiles of the whole.

``percentiles`` sorts all (group, value) pairs over range partitions, counts each group per partition, turns the counts
into offsets, finds the partition that holds each target position, and interpolates its neighbouring order statistics.
The stated error bound is 0: results equal those of one sort of all rows.

Defined results: values that are null, NaN or negative are not measured and take no part; a null group column is a group of its
own; a group without measured values gives no row; an empty table gives an empty result; ties count as often as they occur; of rows
repeated under one key the earliest loaded counts. Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.operators.numbering import same_part, sent, shifted
from lenforge.session import written

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def keyed_state(df: DataFrame, key: Sequence[str], groups: Sequence[str], value: str, order: str | None = None) -> DataFrame:
    """One row (key, groups, value, _at) per key with a measured value; _at is the time of loading, null without ``order``."""
    measured = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) >= 0))
    rest = [c for c in [*groups, value] if c not in key]
    at = F.col(order) if order else F.lit(None).cast("timestamp")
    return combine(measured.select(*key, at.alias("_at"), *rest), key)


def combine(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of each key the earliest loaded row (of equal times the least)."""
    rest = [c for c in rows.columns if c not in key]
    row = rows.groupBy(*key).agg(F.min(F.struct("_at", *(c for c in rest if c != "_at"))).alias("_row"))
    return row.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def combine_states(*states: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keyed state of several parts, each key once."""
    return combine(reduce(DataFrame.unionByName, states), key)


def counted_state(state: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n): map-side counts before the shuffle, so repeated values of a hot group travel once per task."""
    return state.groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def combine_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], at: Sequence[float] = PERCENTILES, partitions: int | None = None) -> DataFrame:
    """(groups, n_values, percentile, value, error_bound) of a counted state."""
    spark = counts.sparkSession
    n_parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*groups, "value"]
    sorted_ = counts.select(*by, "n").repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    # The partition of each row must stay what it was when its counts were taken, hence the written table.
    placed = written(_running(sorted_.withColumn("_part", F.spark_partition_id())))
    offsets, small = sent(shifted(placed, groups, F.col("_end") - F.col("n"), F.col("n")))
    quantile = F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("percentile")
    place = F.col("percentile") * (F.col("_total") - 1)
    targets = (
        offsets.select("*", quantile)
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_pos", F.when(F.col("_side") == 0, F.floor(place)).otherwise(F.ceil(place)))
        .where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_n")))
        .select("_p", *(f"_g{i}" for i in range(len(groups))), (F.col("_pos") - F.col("_before") + F.col("_first")).alias("_spot"), "percentile", "_side", "_total")
    )
    # Two rows per group and percentile, from a table of checked size.
    few = F.broadcast(targets) if small else targets
    within = (F.col("_spot") < F.col("_end")) & (F.col("_spot") >= F.col("_end") - F.col("n"))
    found = placed.join(few, same_part(groups) & within).select(*groups, "percentile", "_side", "_total", F.col("value").cast("double").alias("value"))
    low = F.max(F.when(F.col("_side") == 0, F.col("value")))
    high = F.max(F.when(F.col("_side") == 1, F.col("value")))
    out = found.groupBy(*groups, "percentile", F.col("_total").alias("n_values")).agg(low.alias("_low"), high.alias("_high"))
    spot = F.col("percentile") * (F.col("n_values") - 1)
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (spot - F.floor(spot))
    return out.select(*groups, "n_values", "percentile", value.alias("value"), F.lit(0.0).alias("error_bound"))


def _running(rows: DataFrame) -> DataFrame:
    """Adds _end, the sum of n over the rows of the partition up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy()) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends)], names=[*batch.schema.names, "_end"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, _end bigint")


KEY, GROUPS = ("sample_id", "config_id"), ("dataset", "config_id")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/token_lengths.parquet")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = keyed_state(_lengths(spark, sf_dir), KEY, GROUPS, "total_len", "loaded_at")
    return percentiles(counted_state(state, GROUPS, "total_len"), GROUPS)


def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, from a state per day of built_at, each made of that day's rows alone, and combined by key (a row may be delivered on several days)."""
    rows = _lengths(spark, sf_dir).withColumn("day", F.to_date("built_at"))
    # The states of all days side by side, as a table of one part per day; combining reads the parts and nothing else.
    days = written(keyed_state(rows, [*KEY, "day"], GROUPS, "total_len", "loaded_at"))
    whole = combine_states(days.drop("day"), key=KEY)
    return percentiles(counted_state(whole, GROUPS, "total_len"), GROUPS)


def p2_files_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, from the counts of separate parts that share no key, added up."""
    state = written(keyed_state(_lengths(spark, sf_dir), KEY, GROUPS, "total_len", "loaded_at"))
    parts = [counted_state(state.where(F.pmod(F.xxhash64(*KEY), F.lit(4)) == k), GROUPS, "total_len") for k in range(4)]
    return percentiles(reduce(combine_counts, parts), GROUPS)


_ORACLE = """
WITH once AS (
  SELECT dataset, config_id, total_len FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, config_id ORDER BY loaded_at) AS rn
    FROM token_lengths WHERE total_len IS NOT NULL AND total_len >= 0) WHERE rn = 1),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS percentile),
ranked AS (SELECT dataset, config_id, total_len, row_number() OVER (PARTITION BY dataset, config_id ORDER BY total_len) - 1 AS pos,
                  count(*) OVER (PARTITION BY dataset, config_id) AS n_values FROM once),
ends AS (SELECT dataset, config_id, n_values, percentile::DOUBLE AS percentile,
                max(CASE WHEN pos = floor(percentile::DOUBLE * (n_values - 1)) THEN total_len END)::DOUBLE AS low,
                max(CASE WHEN pos = ceil(percentile::DOUBLE * (n_values - 1)) THEN total_len END)::DOUBLE AS high
         FROM ranked, q GROUP BY ALL)
SELECT dataset, config_id, n_values, percentile,
       low + (high - low) * (percentile * (n_values - 1) - floor(percentile * (n_values - 1))) AS value, 0.0::DOUBLE AS error_bound
FROM ends
"""
ORACLES = {"p2_percentiles": _ORACLE, "p2_days_combined": _ORACLE, "p2_files_combined": _ORACLE}
