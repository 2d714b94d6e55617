"""Queries on schedules, batches, costs and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.catalogue_of_queries import query
from lenforge.functions import encoding
from lenforge.functions import lengths as L
from lenforge.operators import batches, costs, parsers, select
from lenforge.pipeline import DataPipeline, PipelineConfig
from lenforge.plans import planner
from lenforge.queries_tables import _ASSIGNED, _zones_sql, BANDED, CUTOFFS, LIMIT, SHARD, banded, config, doc_lengths, parsed, streamed
from lenforge.session import load, work_folder
from lenforge.sources import readers
from lenforge.streaming import batcher

BATCH = 32


def _profiles(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, tuple[planner.Profile, ...], list[int]]:
    """Banded lengths, categories and the chunked ones among them."""
    if kind == "derived":
        c = config(spark, sf)
        rows = doc_lengths(spark, sf).withColumn("band", L.band_at_load(F.col("total_len"), F.lit(False), c.load_cutoffs(), LIMIT))
        profiles = planner.single_band_profiles(len(c.edges) + 1)
    elif kind == "single":
        rows, profiles = banded(spark, sf), planner.single_band_profiles(len(CUTOFFS) + 2)
    else:
        rows, profiles = banded(spark, sf), planner.DEFAULT_PROFILES
    return rows, profiles, [] if kind == "baseline" else [i for i, p in enumerate(profiles) if p.is_chunked]


def placed(rows: DataFrame) -> DataFrame:
    """Documents in their bands' queues; they have no prompt of their own."""
    return batches.positioned(rows, "doc_id").withColumn("prompt_len", F.lit(0).cast("long"))


def stats(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, planner.Plan]:
    rows, profiles, chunked = _profiles(spark, sf, kind)
    at, plan = batches.scheduled(placed(rows), profiles, BATCH, kind == "baseline")
    return batches.batch_stats(at, chunked, LIMIT), plan


# The default schedule from counts alone: one step per category tried; r: rows left, x: taken, p: place in the queue.
_PLAN = BANDED + """, cnt AS (SELECT count(*) FILTER (band = 0) AS r0, count(*) FILTER (band = 1) AS r1, count(*) FILTER (band = 2) AS r2, count(*) FILTER (band = 3) AS r3 FROM banded),
s AS (SELECT 0 AS step, r0, r1, r2, r3, 0::BIGINT AS x0, 0::BIGINT AS x1, 0::BIGINT AS x2, 0::BIGINT AS x3, false AS fell, -1 AS cat, -1 AS alert FROM cnt
  UNION ALL SELECT step + 1, r0 - n0, r1 - n1, r2 - n2, r3 - n3, n0, n1, n2, n3, f, c, al FROM (
    SELECT step, r0, r1, r2, r3, c,
      CASE WHEN c = 0 THEN a + ea ELSE 0 END AS n0, CASE WHEN c = 0 THEN b + eb WHEN c = 1 THEN a + ea ELSE 0 END AS n1,
      CASE WHEN c = 1 THEN b + eb ELSE 0 END AS n2, CASE WHEN c = 2 THEN least(32, r3) ELSE 0 END AS n3, ea + eb > 0 AS f, CASE WHEN eb > 0 THEN c WHEN ea > 0 THEN c + 1 ELSE -1 END AS al FROM (
      SELECT *, CASE WHEN c < 2 AND a < ta THEN least(32 - a - b, rb - b) ELSE 0 END AS eb,
             CASE WHEN c < 2 AND NOT (a < ta AND rb - b > 0) AND b < 32 - ta THEN least(32 - a - b, ra - a) ELSE 0 END AS ea FROM (
        SELECT *, least(ta, ra) AS a, least(32 - ta, rb) AS b FROM (
          SELECT *, step % 3 AS c, CASE WHEN step % 3 = 0 THEN 13 ELSE 14 END AS ta, CASE WHEN step % 3 = 0 THEN r0 ELSE r1 END AS ra, CASE WHEN step % 3 = 0 THEN r1 ELSE r2 END AS rb
          FROM s WHERE r0 + r1 + r2 + r3 > 0))))),
made AS (SELECT *, row_number() OVER (ORDER BY step) - 1 AS batch_id FROM s WHERE x0 + x1 + x2 + x3 > 0),
slices AS (SELECT batch_id, cat, fell, band, n, sum(n) OVER (PARTITION BY band ORDER BY batch_id) - n AS lo FROM (
  SELECT batch_id, cat, fell, unnest([0, 1, 2, 3]) AS band, unnest([x0, x1, x2, x3]) AS n FROM made) WHERE n > 0)"""
_STATS = _PLAN.replace("WITH ", "") + """, pos AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY k, doc_id) - 1 AS pos FROM banded),
rows AS (SELECT batch_id, cat, fell, total_len FROM pos JOIN slices ON pos.band = slices.band AND pos >= lo AND pos < lo + n),
stats AS (SELECT batch_id, cat AS category, fell AS fell_back, count(*) AS n_rows, CASE WHEN cat = 2 THEN 2048 ELSE ((greatest(1, max(total_len)) + 7) // 8) * 8 END AS width,
  sum(CASE WHEN cat = 2 THEN least(total_len, 2048) ELSE total_len END) AS real_tokens FROM rows GROUP BY batch_id, cat, fell),
full_stats AS (SELECT batch_id::BIGINT AS batch_id, category::INTEGER AS category, n_rows::BIGINT AS n_rows, fell_back, width::BIGINT AS width, (n_rows * width)::BIGINT AS padded_tokens, real_tokens::BIGINT AS real_tokens,
  (n_rows * width - real_tokens)::BIGINT AS pad_tokens FROM stats)"""


@query("q_batch_plan_default", f"WITH RECURSIVE {_PLAN} SELECT batch_id::BIGINT AS batch_id, cat::INTEGER AS category, band::INTEGER AS band, n::BIGINT AS n_rows, lo::BIGINT AS pos_lo, fell AS fell_back FROM slices")
def q_batch_plan_default(spark: SparkSession, sf: str) -> DataFrame:
    """The schedule, a row per batch and band (a fallback slice adjoins the band's first one)."""
    plan = planner.category_plan(batches.band_counts(banded(spark, sf)), planner.DEFAULT_PROFILES, BATCH)
    p = planner.expanded(planner.plan_table(spark, plan))
    return p.groupBy("batch_id", "category", "band", "fell_back").agg(F.sum(F.col("pos_hi") - F.col("pos_lo")).alias("n_rows"), F.min("pos_lo").alias("pos_lo"))


@query("q_plan_health", f"""WITH RECURSIVE {_PLAN}, last AS (SELECT max(step) AS m FROM made), b AS (SELECT unnest([0, 1, 2, 3]) AS band)
SELECT band::INTEGER AS band, (SELECT count(*) FROM made WHERE alert = band)::BIGINT AS empty_alerts, (SELECT count(*) FROM made)::BIGINT AS pools, (SELECT count(*) FROM made WHERE fell)::BIGINT AS fallback_pools,
  (SELECT count(*) FROM s, last WHERE step BETWEEN 1 AND m AND x0 + x1 + x2 + x3 = 0)::BIGINT AS skipped_categories, (SELECT count(*) FROM banded)::BIGINT AS samples_streamed FROM b""")
def q_plan_health(spark: SparkSession, sf: str) -> DataFrame:
    counts = batches.band_counts(banded(spark, sf))
    h = batches.health(planner.category_plan(counts, planner.DEFAULT_PROFILES, BATCH), sum(counts.values()))
    rows = [(b, h["empty_alerts"].get(b, 0), h["pools"], h["fallback_pools"], h["skipped_categories"], h["samples_streamed"]) for b in range(4)]
    return spark.createDataFrame(rows, "band int, empty_alerts bigint, pools bigint, fallback_pools bigint, skipped_categories bigint, samples_streamed bigint")


@query("q_batch_log", f"WITH RECURSIVE {_STATS} SELECT *, 100.0 * pad_tokens::DOUBLE / padded_tokens::DOUBLE AS padding_pct FROM full_stats WHERE batch_id < 20")
def q_batch_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log of the first 20 batches: the cap on pools is the feature."""
    return batches.batch_log(stats(spark, sf, "default")[0], 20)


@query("q_pipeline_pools", f"""WITH {_zones_sql(256)} SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS distinct_rows, sum(total_len)::BIGINT AS ids, sum(CASE WHEN total_len <= 256 THEN total_len WHEN prompt_len >= 256 THEN 256 ELSE 256 END)::BIGINT AS real_tokens,
  0::BIGINT AS uneven_widths FROM cased""")
def q_pipeline_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Samples encoded, sharded and collated by the pipeline of one rank: each row once, all ids kept or windowed, one width per pool."""
    rows = encoding.classified(encoding.encode_zones(parsed(spark, sf).where(parsers.VALID)), 256, 64, 160)
    path = work_folder(spark)
    readers.write_shards(readers.with_shards(rows.select("sample_id", "loaded_at", "prompt_ids", "context_ids", "response_ids", "prompt_len", "context_len", "response_len", "total_len", "is_chunked", "case_code"), ["sample_id", "loaded_at"], SHARD), path)
    pools, _ = DataPipeline(spark, PipelineConfig(shards=path, B=BATCH, band_cutoffs=[64, 160], band_max_seq_len=256, option_b_window=256)).collated()
    each = pools.select("batch_id", F.size("input_ids").alias("w"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("real"), "total_len", "band", "pos")
    by = each.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("band", "pos").alias("d"), F.sum("total_len").alias("ids"), F.sum("real").alias("real"), F.max(F.col("w")).alias("hi"), F.min("w").alias("lo"))
    return by.agg(F.sum("n").alias("n_rows"), F.sum("d").alias("distinct_rows"), F.sum("ids").alias("ids"), F.sum("real").alias("real_tokens"), F.count_if(F.expr("hi <> lo OR hi % 8 <> 0")).alias("uneven_widths"))


@query("q_batch_stats_default", f"WITH RECURSIVE {_STATS} SELECT * FROM full_stats")
def q_batch_stats_default(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf, "default")[0]


_SINGLE = BANDED + """, pos AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY k, doc_id) - 1 AS pos FROM banded), b AS (SELECT band, pos // 32 AS no, total_len FROM pos),
g AS (SELECT band, no, count(*) AS n_rows, max(total_len) AS m, sum(CASE WHEN band = 3 THEN least(total_len, 2048) ELSE total_len END) AS real_tokens FROM b GROUP BY band, no),
w AS (SELECT *, CASE WHEN band = 3 THEN 2048 ELSE ((greatest(1, m) + 7) // 8) * 8 END AS width FROM g)"""


@query("q_batch_stats_single", f"""WITH {_SINGLE} SELECT (row_number() OVER (ORDER BY no, band) - 1)::BIGINT AS batch_id, band::INTEGER AS category, n_rows::BIGINT AS n_rows, false AS fell_back, width::BIGINT AS width,
  (n_rows * width)::BIGINT AS padded_tokens, real_tokens::BIGINT AS real_tokens, (n_rows * width - real_tokens)::BIGINT AS pad_tokens FROM w""")
def q_batch_stats_single(spark: SparkSession, sf: str) -> DataFrame:
    """One category per band: the closed form checks the planner."""
    return stats(spark, sf, "single")[0]


# One row per band in turn: q whole rounds, in which every band gives what it has, then one row of the first bands that have more.
_LEAST = " + ".join(f"least(r{b}, q)" for b in range(4))
_TAKEN = ", ".join(f"least(r{b}, q) + (r{b} > q AND {' + '.join(['0', *(f'(r{a} > q)::INTEGER' for a in range(b))])} < e)::INTEGER AS t{b}" for b in range(4))
_BASE = BANDED + f""", cnt AS (SELECT count(*) FILTER (band = 0) AS r0, count(*) FILTER (band = 1) AS r1, count(*) FILTER (band = 2) AS r2, count(*) FILTER (band = 3) AS r3 FROM banded),
s AS (SELECT 0 AS step, r0, r1, r2, r3, 0::BIGINT AS x0, 0::BIGINT AS x1, 0::BIGINT AS x2, 0::BIGINT AS x3 FROM cnt
  UNION ALL SELECT step + 1, r0 - t0, r1 - t1, r2 - t2, r3 - t3, t0, t1, t2, t3 FROM (SELECT *, {_TAKEN} FROM (SELECT *, 32 - ({_LEAST}) AS e FROM (
    SELECT *, list_max(list_filter(range(33), lambda q: {_LEAST} <= 32)) AS q FROM s WHERE r0 + r1 + r2 + r3 > 0)))),
slices AS (SELECT step - 1 AS batch_id, band, n, sum(n) OVER (PARTITION BY band ORDER BY step) - n AS lo FROM (SELECT step, unnest([0, 1, 2, 3]) AS band, unnest([x0, x1, x2, x3]) AS n FROM s WHERE step > 0) WHERE n > 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY k, doc_id) - 1 AS pos FROM banded),
base AS (SELECT batch_id, count(*) AS n_rows, ((greatest(1, max(total_len)) + 7) // 8) * 8 AS width, sum(total_len) AS real_tokens FROM pos JOIN slices ON pos.band = slices.band AND pos >= lo AND pos < lo + n GROUP BY batch_id)"""


@query("q_batch_stats_baseline", f"""WITH RECURSIVE {_BASE} SELECT batch_id::BIGINT AS batch_id, (-1)::INTEGER AS category, n_rows::BIGINT AS n_rows, false AS fell_back, width::BIGINT AS width, (n_rows * width)::BIGINT AS padded_tokens,
  real_tokens::BIGINT AS real_tokens, (n_rows * width - real_tokens)::BIGINT AS pad_tokens FROM base""")
def q_batch_stats_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf, "baseline")[0]


@query("q_batch_stats_derived")
def q_batch_stats_derived(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf, "derived")[0]


@query("q_epoch_stats", f"""WITH RECURSIVE {_STATS} SELECT count(*)::BIGINT AS pools, sum(n_rows)::BIGINT AS samples, sum(padded_tokens)::BIGINT AS padded_tokens, sum(real_tokens)::BIGINT AS real_tokens, sum(pad_tokens)::BIGINT AS pad_tokens,
  count(*) FILTER (fell_back)::BIGINT AS fallback_pools, sum(padded_tokens)::DOUBLE AS proxy_cost, 100.0 * sum(pad_tokens)::DOUBLE / sum(padded_tokens)::DOUBLE AS padding_pct, 100.0 * sum(real_tokens)::DOUBLE / sum(padded_tokens)::DOUBLE AS useful_pct FROM full_stats""")
def q_epoch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return batches.epoch_stats(stats(spark, sf, "default")[0])


@query("q_per_category", f"WITH RECURSIVE {_STATS} SELECT category, count(*)::BIGINT AS pools, sum(padded_tokens)::BIGINT AS padded_tokens, sum(pad_tokens)::BIGINT AS pad_tokens FROM full_stats GROUP BY category")
def q_per_category(spark: SparkSession, sf: str) -> DataFrame:
    return batches.per_category(stats(spark, sf, "default")[0])


@query("q_proxy_cost", f"WITH RECURSIVE {_STATS} SELECT batch_id, 2.0::DOUBLE * padded_tokens + 5.0 + 0.5::DOUBLE * padded_tokens::DOUBLE * padded_tokens::DOUBLE AS cost FROM full_stats")
def q_proxy_cost(spark: SparkSession, sf: str) -> DataFrame:
    return stats(spark, sf, "default")[0].select("batch_id", L.proxy_cost(F.col("padded_tokens").cast("double"), 2.0, 5.0, 0.5).alias("cost"))


_TOTALS = "sum({0})::BIGINT AS {2}padded_tokens, sum({0})::DOUBLE AS {2}proxy_cost, 100.0 * sum({1})::DOUBLE / sum({0})::DOUBLE AS {2}padding_pct"


@query("q_compare", f"""SELECT *, 100.0 * (base_padded_tokens - padded_tokens)::DOUBLE / base_padded_tokens::DOUBLE AS padded_reduction_pct, 100.0 * (base_proxy_cost - proxy_cost) / base_proxy_cost AS cost_reduction_pct
FROM (WITH RECURSIVE {_STATS} SELECT {_TOTALS.format("padded_tokens", "pad_tokens", "")} FROM full_stats), (WITH RECURSIVE {_BASE} SELECT {_TOTALS.format("n_rows * width", "(n_rows * width - real_tokens)", "base_")} FROM base)""")
def q_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The category schedule against the rotation over bands."""
    queues = placed(banded(spark, sf))
    return batches.run_epochs(queues, planner.DEFAULT_PROFILES, BATCH, LIMIT)


@query("q_compare_derived")
def q_compare_derived(spark: SparkSession, sf: str) -> DataFrame:
    return batches.compare(batches.epoch_stats(stats(spark, sf, "derived")[0]), batches.epoch_stats(stats(spark, sf, "default")[0]))


@query("q_rank_totals", f"""WITH {_ASSIGNED}, g AS (SELECT rank, band, count(*) AS n, sum(total_len) AS ids FROM sharded JOIN assigned USING (shard_id) GROUP BY rank, band)
SELECT rank::BIGINT AS rank, sum(n)::BIGINT AS n_rows, sum(ids)::BIGINT AS ids, sum((n + 31) // 32)::BIGINT AS single_band_batches FROM g GROUP BY rank""")
def q_rank_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, ids and batches per rank of a two-rank epoch; partial sums, then one sum per rank."""
    g = streamed(spark, sf).groupBy("rank", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("total_len").alias("ids"))
    return g.groupBy("rank").agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("ids"), F.sum(F.ceil(F.col("n") / BATCH)).alias("single_band_batches"))


#: Shard files of a micro-batch of the stream: 8,192 shards, 2,048 resident windows of four.
STREAM_FILES = 128


def _streamed_batches(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark)
    readers.write_shards(readers.with_shards(banded(spark, sf, once=True), ["doc_id"], SHARD), f"{folder}/in")
    schema = "doc_id bigint, band int, total_len bigint, shard_id bigint, sample_idx bigint"
    return batcher.run(spark, f"{folder}/in/*", schema, f"{folder}/out", f"{folder}/state", 4, BATCH, shard="shard_id", files=STREAM_FILES)


@query("q_stream_batches")
def q_stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a stream of shard files, four shards a window, with leftovers carried over; a row per batch."""
    rows = _streamed_batches(spark, sf)
    return rows.groupBy("batch_id", "band").agg(F.count(F.lit(1)).alias("n_rows"), F.max("total_len").alias("longest"), F.sum("total_len").alias("ids"))


@query("q_stream_totals", f"""WITH {BANDED} SELECT band::INTEGER AS band, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS distinct_rows, sum(total_len)::BIGINT AS ids, ((count(*) + 31) // 32)::BIGINT AS batches FROM banded GROUP BY band""")
def q_stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream must keep: each row in one batch, and per band only the last batch short, whatever the windows."""
    rows = _streamed_batches(spark, sf)
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("distinct_rows"), F.sum("total_len").alias("ids"), F.countDistinct("batch_id").alias("batches"))


# --- collation -------------------------------------------------------------------------------------------------------


def _collate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tokenized rows in batches of their config: eight neighbours by sample_id // 8, each delivered row once."""
    rows = load(spark, sf, "tokenized").dropDuplicates(["sample_id", "config_id"])  # repeated rows have the same arrays
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    rows = rows.withColumn("total_len", size("prompt_ids") + size("context_ids") + size("response_ids"))
    return rows.withColumn("batch_id", F.concat_ws("-", "config_id", F.floor(F.col("sample_id") / 8)))


_COLL = """c AS (SELECT DISTINCT ON (sample_id, config_id) sample_id, config_id, config_id::VARCHAR || '-' || (sample_id // 8)::VARCHAR AS batch_id, len(coalesce(prompt_ids, [])) + len(coalesce(context_ids, [])) AS pc,
  list_concat(list_concat(coalesce(prompt_ids, []), coalesce(context_ids, [])), coalesce(response_ids, [])) AS ids, coalesce(response_ids, []) AS r FROM tokenized),
w AS (SELECT *, ((greatest(1, max(len(ids)) OVER (PARTITION BY batch_id)) + 7) // 8) * 8 AS width FROM c)"""
_FILL = "list_transform(range({0}), lambda i: {1})"


@query("q_collate_mask", f"""WITH {_COLL} SELECT batch_id, sample_id, config_id, width::BIGINT AS width, array_to_string(list_concat(ids, {_FILL.format("width - len(ids)", "0")}), ',') AS input_ids,
  array_to_string(list_concat({_FILL.format("len(ids)", "1")}, {_FILL.format("width - len(ids)", "0")}), ',') AS attention_mask FROM w""")
def q_collate_mask(spark: SparkSession, sf: str) -> DataFrame:
    c = batches.collated(_collate_rows(spark, sf))
    return c.select("batch_id", "sample_id", "config_id", "width", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


@query("q_collate_labels", f"""WITH {_COLL} SELECT batch_id, sample_id, config_id, array_to_string(list_concat(list_concat({_FILL.format("pc", "-100")}, r), {_FILL.format("width - pc - len(r)", "-100")}), ',') AS labels FROM w""")
def q_collate_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = batches.collated(_collate_rows(spark, sf))
    return c.select("batch_id", "sample_id", "config_id", F.array_join("labels", ",").alias("labels"))


@query("q_collate_chunked", """WITH c AS (SELECT sample_id, config_id, config_id::VARCHAR || '-' || (sample_id // 8)::VARCHAR AS batch_id, option_b_window AS b, ((option_b_window + 7) // 8) * 8 AS width, len(coalesce(prompt_ids, [])) AS p,
  len(coalesce(prompt_ids, [])) + len(coalesce(context_ids, [])) AS pc, list_concat(list_concat(coalesce(prompt_ids, []), coalesce(context_ids, [])), coalesce(response_ids, [])) AS ids, max_seq_length FROM tokenized JOIN build_config USING (config_id)),
k AS (SELECT *, CASE WHEN p >= b THEN least(p, width) ELSE least(len(ids), b) END AS n FROM c WHERE len(ids) > max_seq_length)
SELECT batch_id, sample_id, config_id, width::BIGINT AS width, n::BIGINT AS ones, greatest(0, n - pc)::BIGINT AS kept, list_sum(list_transform(range(1, n + 1), lambda i: ids[i]::BIGINT * i))::BIGINT AS id_sum,
  coalesce(list_sum(list_transform(range(pc + 1, n + 1), lambda i: ids[i]::BIGINT * i)), 0)::BIGINT AS label_sum FROM k""")
def q_collate_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Chunked collation of the rows over the limit of their config; the sums weigh each id by its place."""
    limits = load(spark, sf, "build_config").select("config_id", "max_seq_length", "option_b_window")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    rows = load(spark, sf, "tokenized").withColumn("total_len", size("prompt_ids") + size("context_ids") + size("response_ids"))
    over = rows.join(F.broadcast(limits), "config_id").where("total_len > max_seq_length")  # one row per config
    c = batches.collated(over.withColumn("batch_id", F.concat_ws("-", "config_id", F.floor(F.col("sample_id") / 8))), window="option_b_window")
    total = lambda col, v: F.aggregate(F.transform(col, lambda x, i: F.when(x != v, x.cast("long") * (i + 1)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    ones = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("batch_id", "sample_id", "config_id", "width", ones.alias("ones"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("kept"), total("input_ids", 0).alias("id_sum"), total("labels", -100).alias("label_sum"))


@query("q_chunk_window", """SELECT sample_id, config_id, (CASE WHEN prompt_len >= 256 THEN least(prompt_len, 256) ELSE least(total_len, 256) END)::BIGINT AS real_tokens,
  (CASE WHEN prompt_len >= 256 THEN 0 ELSE greatest(0, least(total_len, 256) - prompt_len - context_len) END)::BIGINT AS loss_tokens
FROM token_lengths WHERE total_len > 256 AND prompt_len IS NOT NULL AND context_len IS NOT NULL""")
def q_chunk_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "token_lengths").where("total_len > 256 AND prompt_len IS NOT NULL AND context_len IS NOT NULL")
    p, c, t = F.col("prompt_len"), F.col("context_len"), F.col("total_len")
    return rows.select("sample_id", "config_id", L.window_real(p, t, 256, 256).cast("long").alias("real_tokens"), L.window_loss(p, c, t, 256).cast("long").alias("loss_tokens"))


# --- costs -----------------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT w.v AS width, n.v AS n_rows, r.v AS rep FROM (SELECT unnest([128, 256, 512, 768, 1024]) AS v) w, (SELECT unnest([4, 8]) AS v) n, (SELECT unnest([0, 1, 2, 3]) AS v) r)"
_TIMED = _RUNS + ", timed AS (SELECT n_rows, width, 0.01::DOUBLE + 0.000002::DOUBLE * n_rows * width + 0.000000001::DOUBLE * n_rows * width * width + 0.0001::DOUBLE * rep AS seconds FROM runs)"


def _runs(spark: SparkSession) -> DataFrame:
    """Synthetic timings of eight shapes in four repeats."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (128, 256, 512, 768, 1024)))).alias("width")).select("width", F.explode(F.array(F.lit(4), F.lit(8))).alias("n_rows")).select("width", "n_rows", F.explode(F.array(*map(F.lit, range(4)))).alias("rep"))
    x = F.col("n_rows") * F.col("width")
    return grid.select("n_rows", "width", (F.lit(0.01) + 0.000002 * x + 0.000000001 * x * F.col("width") + 0.0001 * F.col("rep")).alias("seconds"))


@query("q_median_repeats", f"WITH {_TIMED} SELECT n_rows::INTEGER AS n_rows, width::INTEGER AS width, round(median(seconds), 9) AS seconds FROM timed GROUP BY ALL")
def q_median_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return costs.medians(_runs(spark)).withColumn("seconds", F.round("seconds", 9))


@query("q_cost_fit", "SELECT 0.01015::DOUBLE AS d, 0.000002::DOUBLE AS a, 0.000000001::DOUBLE AS c, 0.0::DOUBLE AS max_residual")
def q_cost_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = costs.fit(costs.medians(_runs(spark)))
    return f.select(F.round("d", 6).alias("d"), F.round("a", 9).alias("a"), F.round("c", 12).alias("c"), F.round("max_residual", 6).alias("max_residual"))


@query("q_epoch_estimate", f"WITH RECURSIVE {_STATS} SELECT round(sum(0.01::DOUBLE + 0.000002::DOUBLE * n_rows * width + 0.000000001::DOUBLE * n_rows * width * width) / 3600.0, 9) AS hours FROM full_stats")
def q_epoch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return costs.epoch_hours(stats(spark, sf, "default")[0], 0.000002, 0.000000001, 0.01).select(F.round("hours", 9).alias("hours"))


# --- selection -------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str, capacity: int = 16) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the buffer of the last ones by vec_id."""
    v = load(spark, sf, "embeddings")
    return v, select.last(v.select("vec_id", F.col("embedding").alias("held")), "vec_id", capacity)


_DIV = """held AS (SELECT embedding AS h FROM embeddings ORDER BY vec_id DESC LIMIT 16),
dist AS (SELECT vec_id, label, avg(sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: pow(embedding[i]::DOUBLE - h[i]::DOUBLE, 2))))) AS s_inter FROM embeddings, held GROUP BY vec_id, label)"""


@query("q_fifo_buffer", "SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 16")
def q_fifo_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf)[1].select("vec_id")


@query("q_diversity", f"WITH {_DIV} SELECT vec_id, round(s_inter, 6) AS s_inter FROM dist")
def q_diversity(spark: SparkSession, sf: str) -> DataFrame:
    v, held = _vectors(spark, sf)
    return select.diversity(v, "vec_id", "embedding", held, "held").withColumn("s_inter", F.round("s_inter", 6))


_ZED = _DIV + ", z AS (SELECT vec_id, label, round((s_inter - avg(s_inter) OVER (PARTITION BY label)) / greatest(coalesce(stddev_samp(s_inter) OVER (PARTITION BY label), 0), 1e-6), 6) + 0.0::DOUBLE AS score FROM dist)"


def _scored(spark: SparkSession, sf: str, capacity: int = 16) -> DataFrame:
    v, held = _vectors(spark, sf, capacity)
    d = select.diversity(v, "vec_id", "embedding", held, "held").join(v.select("vec_id", "label"), "vec_id")
    return select.z_norm(d, "s_inter", "label", "_z").select("vec_id", "label", (F.round("_z", 6) + F.lit(0.0)).alias("score"))


@query("q_znorm", f"WITH {_ZED} SELECT vec_id, label, score FROM z")
def q_znorm(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


@query("q_topk_local", f"WITH {_ZED} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM z) WHERE r <= 8")
def q_topk_local(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_local(_scored(spark, sf), "label", "score", "vec_id", 8).select("label", "vec_id")


@query("q_topk_global", f"""WITH {_ZED}, t AS (SELECT min(score) AS t FROM (SELECT score FROM z ORDER BY score DESC LIMIT 32)),
k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label % 4 ORDER BY score DESC, vec_id) AS r FROM z, t WHERE score >= t) SELECT label, vec_id FROM k WHERE r <= 8""")
def q_topk_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumn("rank", F.col("label") % 4)
    return select.top_global(rows, "rank", "score", "vec_id", 8, 4).select("label", "vec_id")


# The same with the buffer and the number of chosen rows of SelectConfig.
_FULL = select.SelectConfig()
_DIV_FULL, _ZED_FULL = (x.replace("LIMIT 16)", f"LIMIT {_FULL.capacity})") for x in (_DIV, _ZED))


@query("q_diversity_full", f"WITH {_DIV_FULL} SELECT vec_id, round(s_inter, 6) AS s_inter FROM dist")
def q_diversity_full(spark: SparkSession, sf: str) -> DataFrame:
    v, held = _vectors(spark, sf, _FULL.capacity)
    return select.diversity(v, "vec_id", "embedding", held, "held", _FULL.capacity).withColumn("s_inter", F.round("s_inter", 6))


@query("q_topk_local_full", f"WITH {_ZED_FULL} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM z) WHERE r <= {_FULL.top}")
def q_topk_local_full(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_local(_scored(spark, sf, _FULL.capacity), "label", "score", "vec_id", _FULL.top).select("label", "vec_id")


@query("q_topk_global_full", f"""WITH {_ZED_FULL}, t AS (SELECT min(score) AS t FROM (SELECT score FROM z ORDER BY score DESC LIMIT {4 * _FULL.top})),
k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label % 4 ORDER BY score DESC, vec_id) AS r FROM z, t WHERE score >= t) SELECT label, vec_id FROM k WHERE r <= {_FULL.top}""")
def q_topk_global_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf, _FULL.capacity).withColumn("rank", F.col("label") % 4)
    return select.top_global(rows, "rank", "score", "vec_id", _FULL.top, 4).select("label", "vec_id")


def _selected(spark: SparkSession, sf: str, shared: bool) -> DataFrame:
    """Items of two vectors, 64 of them in a pool of each of two ranks; the first pool falls in the warm-up. Settings as in production."""
    item = F.floor(F.col("vec_id") / 2)
    rows = load(spark, sf, "embeddings").select(item.alias("item"), (F.col("vec_id") % 2).alias("pos"), "embedding", (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))
    scores = select.item_scores(rows, "item", "pos", "embedding", "mask", 64)
    at = scores.withColumn("step", F.lit(select.SelectConfig().warm_up - 1) + F.floor(F.col("item") / 128)).withColumn("rank", F.col("item") % 2)
    return select.select_pools(at, "step", "rank", "item", shared)


@query("q_select_local")
def q_select_local(spark: SparkSession, sf: str) -> DataFrame:
    """Selection by utility and diversity, each rank for itself."""
    return _selected(spark, sf, False)


@query("q_select_global")
def q_select_global(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all ranks, with a shared buffer."""
    return _selected(spark, sf, True)


@query("q_jl_projection")
def q_jl_projection(spark: SparkSession, sf: str) -> DataFrame:
    return select.fast_jl(load(spark, sf, "embeddings"), "vec_id", "embedding", 64)


@query("q_nuclear_norm")
def q_nuclear_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Utility of pool items of eight vectors."""
    v = load(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("item"), "embedding")
    return select.nuclear_norm(v, "item", "embedding")


@query("q_masked_mean", """SELECT vec_id % 8 AS pool, d::INTEGER AS d, round(avg(embedding[d]::DOUBLE), 5) + 0.0::DOUBLE AS mean FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS d) WHERE vec_id % 5 <> 0 GROUP BY ALL""")
def q_masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings").select((F.col("vec_id") % 8).alias("pool"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))
    m = select.masked_mean(v, "pool", "v", "mask")
    return m.select("pool", F.posexplode("mean").alias("p", "m")).select("pool", (F.col("p") + 1).alias("d"), (F.round("m", 5) + F.lit(0.0)).alias("mean"))
