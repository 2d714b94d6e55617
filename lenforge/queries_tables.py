"""Queries on sources, zones, lengths, shards and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.catalogue_of_queries import query
from lenforge.functions import encoding
from lenforge.functions import lengths as L
from lenforge.operators import bands, batches, parsers
from lenforge.session import load, work_folder, written
from lenforge.sources import readers, synthetic
from lenforge.sources.catalog import FORMATS, DatasetSpec

LIMIT, CUTOFFS, SHARD = 2048, (512, 1536), 128

# SQL shared by several queries: lengths of documents, in words.
DOCS = """docs AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS total_len FROM documents
  WHERE text IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\f]'))"""
BANDED = DOCS + """, banded AS (SELECT doc_id, total_len, CASE WHEN total_len > 2048 THEN 3 WHEN total_len < 512 THEN 0 WHEN total_len < 1536 THEN 1 ELSE 2 END AS band,
  md5('42-' || doc_id::VARCHAR) AS k FROM docs)"""


def doc_lengths(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    """``once``: lengths are written before any are dropped, as a filter counts the words again, and so does each pass over its rows."""
    counted = load(spark, sf, "documents").select("doc_id", L.n_words(F.col("text")).cast("long").alias("total_len"))
    return (written(counted) if once else counted).where("total_len > 0")


def banded(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    return doc_lengths(spark, sf, once).withColumn("band", L.band_at_load(F.col("total_len"), F.lit(False), CUTOFFS, LIMIT))


# --- zones -----------------------------------------------------------------------------------------------------------

# Unicode white space, as parsers strip it.
_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("q_alpaca_parse", f"""WITH stripped AS (SELECT sample_id, dataset, {", ".join(f"regexp_replace(coalesce({c}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS {c}" for c in ("instruction", "context", "response"))}
  FROM raw_samples JOIN source_catalog ON dataset = name WHERE format = 'alpaca')
SELECT * FROM stripped WHERE length(instruction) > 0 AND length(response) > 0""")
def q_alpaca_parse(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of every source whose format is alpaca, through its parser."""
    names = load(spark, sf, "source_catalog").where("format = 'alpaca'").select(F.col("name").alias("dataset"))
    rows = load(spark, sf, "raw_samples").join(F.broadcast(names), "dataset")  # one row per source
    raw = rows.select("sample_id", "dataset", "instruction", F.col("context").alias("input"), "response", F.lit(None).cast("string").alias("output"))
    return parsers.alpaca(raw, ("sample_id", "dataset")).where(parsers.VALID)


def _stripped(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query("q_pair_parse", f"""SELECT * FROM (SELECT doc_id, {_stripped("source")} AS instruction, '' AS context, {_stripped("text")} AS response FROM documents)
WHERE length(instruction) > 0 AND length(response) > 0""")
def q_pair_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.pair(load(spark, sf, "documents"), "source", "text", None, ("doc_id",)).where(parsers.VALID)


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, turns): lines "role: content" of chat documents; a line without a role goes on the turn before it as a turn of its own."""
    rows = load(spark, sf, "documents").where("layout = 'chat' AND text IS NOT NULL")
    at = lambda t: F.instr(t, ": ")
    turn = lambda t: F.struct(parsers.role(F.when(at(t) > 0, F.substring(t, F.lit(1), at(t) - 1)).otherwise(F.lit(""))).alias("role"), F.trim(F.when(at(t) > 0, F.substring(t, at(t) + 2, F.length(t))).otherwise(t)).alias("content"))
    return rows.select("doc_id", F.transform(F.split("text", "\n"), turn).alias("turns"))


_TURNS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE layout = 'chat' AND text IS NOT NULL),
parts AS (SELECT doc_id, i, CASE WHEN strpos(line, ': ') > 0 THEN lower(substr(line, 1, strpos(line, ': ') - 1)) ELSE '' END AS r0,
  trim(CASE WHEN strpos(line, ': ') > 0 THEN substr(line, strpos(line, ': ') + 2) ELSE line END) AS content FROM lines),
turns AS (SELECT doc_id, i, content, CASE WHEN r0 IN ('user', 'human', 'prompter') THEN 'user' WHEN r0 IN ('assistant', 'gpt', 'bot', 'model') THEN 'assistant' ELSE r0 END AS role FROM parts)"""


@query("q_role_normalize", f"WITH {_TURNS} SELECT role, count(*)::BIGINT AS turns FROM turns GROUP BY role")
def q_role_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Turns by role; roles without another name are kept as they are."""
    t = chat_turns(spark, sf).select(F.explode("turns").alias("t")).select("t.role")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("turns"))


@query("q_chat_parse", f"""WITH {_TURNS}, a AS (SELECT doc_id, max(i) AS ai FROM turns WHERE role = 'assistant' GROUP BY doc_id),
u AS (SELECT t.doc_id, max(i) AS ui FROM turns t JOIN a USING (doc_id) WHERE role = 'user' AND i < ai GROUP BY t.doc_id),
c AS (SELECT t.doc_id, string_agg(role || ': ' || content, chr(10) ORDER BY i) AS context FROM turns t JOIN u USING (doc_id) WHERE i < ui AND length(content) > 0 GROUP BY t.doc_id)
SELECT u.doc_id, q.content AS instruction, coalesce(context, '') AS context, r.content AS response FROM u JOIN a USING (doc_id)
JOIN turns q ON q.doc_id = u.doc_id AND q.i = ui JOIN turns r ON r.doc_id = u.doc_id AND r.i = ai LEFT JOIN c ON c.doc_id = u.doc_id
WHERE length(q.content) > 0 AND length(r.content) > 0""")
def q_chat_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.chat(chat_turns(spark, sf), F.col("turns"), ("doc_id",)).where(parsers.VALID)


# The context of a chat is its first turn; a pair source that names no field for it has none.
@query("q_union_sources", f"""SELECT dataset, instruction, CASE WHEN format = 'chat' AND length(context) > 0 THEN 'system: ' || context WHEN format IN ('pair', 'io', 'fields') AND context_field IS NULL THEN '' ELSE context END AS context, response FROM (
  SELECT dataset, format, context_field, {_stripped("instruction")} AS instruction, {_stripped("context")} AS context, {_stripped("response")} AS response FROM raw_samples JOIN source_catalog ON dataset = name)
WHERE length(instruction) > 0 AND length(response) > 0""")
def q_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All sources as one bag: each is written as JSON lines in its own format, and read back and parsed by its entry of the catalog."""
    entries = load(spark, sf, "source_catalog").select("name", "format", "prompt_field", "response_field", "context_field").collect()  # one row per source
    folder = work_folder(spark)
    specs = [DatasetSpec(e.name, f"{folder}/dataset={e.name}", format=e.format, **{k: v for k, v in {"prompt_field": e.prompt_field, "response_field": e.response_field, "context_field": e.context_field}.items() if v}) for e in entries]
    kinds = spark.createDataFrame([(s.name, FORMATS[s.format], s.prompt_field, s.response_field, s.context_field or "no_context") for s in specs], "dataset string, kind string, p string, r string, c string")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    line = F.when(F.col("kind") == "alpaca", F.to_json(F.struct("instruction", F.col("context").alias("input"), F.col("response").alias("output"))))
    line = line.when(F.col("kind") == "chat", F.to_json(F.struct(F.array(turn("system", "context"), turn("human", "instruction"), turn("gpt", "response")).alias("messages"))))
    line = line.otherwise(F.to_json(F.map_from_arrays(F.array("p", "r", "c"), F.array("instruction", "response", "context"))))
    rows = load(spark, sf, "raw_samples").join(F.broadcast(kinds), "dataset")  # one row per source
    rows.select("dataset", line.alias("value")).write.partitionBy("dataset").text(folder)
    return readers.merged(spark, [s for s in specs if readers.exists(spark, s.path)])


_ZONED = f"""stripped AS (SELECT sample_id, loaded_at, dataset, {", ".join(f"{_stripped(c)} AS {c}" for c in ("instruction", "context", "response"))} FROM raw_samples),
valid AS (SELECT * FROM stripped WHERE length(instruction) > 0 AND length(response) > 0)"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """raw_samples through the alpaca parser, valid or not."""
    raw = load(spark, sf, "raw_samples").withColumns({"input": F.col("context"), "output": F.lit(None).cast("string")})
    return parsers.alpaca(raw, ("sample_id", "loaded_at", "dataset"))


@query("q_source_stats", f"WITH {_ZONED} SELECT dataset, count(*)::BIGINT AS n_read, count(*) FILTER (WHERE length(instruction) > 0 AND length(response) > 0)::BIGINT AS n_kept FROM stripped GROUP BY dataset")
def q_source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.source_stats(parsed(spark, sf), F.expr(parsers.VALID))


@query("q_capped_scan", """SELECT dataset, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY r.dataset ORDER BY sample_id, loaded_at) AS rn
FROM raw_samples r JOIN source_catalog c ON r.dataset = c.name) WHERE coalesce(row_limit, 0) = 0 OR rn <= row_limit""")
def q_capped_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of each source up to its row_limit: the cap is the feature."""
    caps = load(spark, sf, "source_catalog").select(F.col("name").alias("dataset"), "row_limit")
    return readers.capped_by(load(spark, sf, "raw_samples").select("dataset", "sample_id", "loaded_at"), "dataset", ["sample_id", "loaded_at"], caps).select("dataset", "sample_id")


# A zone's words: those of its prefix, and those of its text; a prefix ends in a space, so the two never touch.
def _zones_sql(limit: int) -> str:
    w = "len(regexp_extract_all({0}, '[^ \\t\\n\\r\\f]+'))"
    return f"""{_ZONED}, zones AS (SELECT sample_id, loaded_at, {w.format("'### Instruction: ' || instruction")} + 1 AS prompt_len,
  CASE WHEN length(context) > 0 THEN {w.format("'### Input: ' || context")} ELSE 0 END AS context_len,
  {w.format("'### Response: ' || response")} + 1 AS response_len FROM valid),
cased AS (SELECT *, prompt_len + context_len + response_len AS total_len,
  CASE WHEN prompt_len + context_len + response_len <= {limit} THEN 0 WHEN prompt_len + context_len > {limit // 2} AND response_len > {limit // 2} THEN 3
       WHEN response_len > {limit // 2} THEN 2 ELSE 1 END AS case_code FROM zones)"""


def zones(spark: SparkSession, sf: str) -> DataFrame:
    z = L.zone_lengths()
    out = parsed(spark, sf).where(parsers.VALID).select("sample_id", "loaded_at", *(c.cast("long").alias(k) for k, c in z.items()))
    return out.withColumn("total_len", F.col("prompt_len") + F.col("context_len") + F.col("response_len"))


@query("q_zone_lengths", f"WITH {_zones_sql(256)} SELECT sample_id, loaded_at, prompt_len::BIGINT AS prompt_len, context_len::BIGINT AS context_len, response_len::BIGINT AS response_len, total_len::BIGINT AS total_len FROM cased")
def q_zone_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return zones(spark, sf)


_IDS = "list_transform(regexp_extract_all({0}, '[^ \\t\\n\\r\\f]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 49997 + 3)"


@query("q_encode_zones", f"""WITH {_ZONED}, ids AS (SELECT sample_id, loaded_at, list_prepend(1, {_IDS.format("'### Instruction: ' || instruction")}) AS p,
  CASE WHEN length(context) > 0 THEN {_IDS.format("chr(10) || '### Input: ' || context")} ELSE [] END AS c, list_append({_IDS.format("chr(10) || '### Response: ' || response")}, 2) AS r FROM valid)
SELECT sample_id, loaded_at, array_to_string(p, ',') AS prompt_ids, array_to_string(c, ',') AS context_ids, array_to_string(r, ',') AS response_ids, (len(p) + len(c) + len(r))::BIGINT AS total_len FROM ids""")
def q_encode_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of each zone, with begin and end ids."""
    e = encoding.encode_zones(parsed(spark, sf).where(parsers.VALID))
    return e.select("sample_id", "loaded_at", *(F.array_join(c, ",").alias(c) for c in ("prompt_ids", "context_ids", "response_ids")), F.col("total_len").cast("long").alias("total_len"))


@query("q_case_codes", f"WITH {_zones_sql(256)} SELECT case_code::INTEGER AS case_code, count(*)::BIGINT AS n FROM cased GROUP BY 1")
def q_case_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = L.case_code(F.col("prompt_len"), F.col("context_len"), F.col("response_len"), 256)
    return zones(spark, sf).groupBy(code.alias("case_code")).agg(F.count(F.lit(1)).alias("n"))


@query("q_chunk_bounds", f"WITH {_zones_sql(256)} SELECT sample_id, loaded_at, unnest(generate_series(256, total_len - 1, 256))::BIGINT AS bound FROM cased WHERE total_len > 256")
def q_chunk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = zones(spark, sf).select("sample_id", "loaded_at", F.explode(L.chunk_bounds(F.col("total_len").cast("int"), 256)).alias("bound"))
    return bounds.withColumn("bound", F.col("bound").cast("long"))


# --- bands, shards ---------------------------------------------------------------------------------------------------


@query("q_band_offline", f"WITH {DOCS} SELECT doc_id, (CASE WHEN total_len > 2048 THEN 3 WHEN total_len < 512 THEN 0 WHEN total_len < 1536 THEN 1 ELSE 2 END)::INTEGER AS band FROM docs")
def q_band_offline(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lengths(spark, sf).select("doc_id", L.band_offline(F.col("total_len"), F.col("total_len") > LIMIT, 512, 1536).alias("band"))


@query("q_band_load_time", """SELECT sample_id, config_id, (CASE WHEN is_chunked = 1 OR total_len > 1024 THEN 4 WHEN total_len < 64 THEN 0 WHEN total_len < 160 THEN 1 WHEN total_len < 384 THEN 2 ELSE 3 END)::INTEGER AS band
FROM token_lengths WHERE total_len >= 0""")
def q_band_load_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "token_lengths").where("total_len >= 0")
    return rows.select("sample_id", "config_id", L.band_at_load(F.col("total_len"), F.coalesce(F.col("is_chunked") == 1, F.lit(False)), (64, 160, 384), 1024).alias("band"))


@query("q_band_counts", f"WITH {BANDED}, b AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS band) SELECT b.band, count(doc_id)::BIGINT AS n FROM b LEFT JOIN banded ON b.band = banded.band GROUP BY b.band")
def q_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    every = spark.range(4).select(F.col("id").cast("int").alias("band"))
    counts = banded(spark, sf).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "band", "left").fillna({"n": 0})


@query("q_length_histogram", f"WITH {DOCS} SELECT total_len AS len, count(*)::BIGINT AS n FROM docs WHERE total_len <= 2048 GROUP BY 1")
def q_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return bands.histogram(doc_lengths(spark, sf), LIMIT)


@query("q_meta", f"""WITH {DOCS} SELECT count(*)::BIGINT AS num_samples, ceil(count(*) / 128.0)::BIGINT AS num_shards, count(*) FILTER (WHERE total_len > 2048)::BIGINT AS num_chunked,
  min(total_len) AS min_len, max(total_len) AS max_len, sum(total_len)::BIGINT AS sum_len, count(*) / ceil(count(*) / 128.0)::DOUBLE AS avg_shard_samples FROM docs""")
def q_meta(spark: SparkSession, sf: str) -> DataFrame:
    shards = F.ceil(F.count(F.lit(1)) / SHARD)
    return doc_lengths(spark, sf).agg(
        F.count(F.lit(1)).alias("num_samples"), shards.alias("num_shards"), F.count_if(F.col("total_len") > LIMIT).alias("num_chunked"), F.min("total_len").alias("min_len"), F.max("total_len").alias("max_len"),
        F.sum("total_len").alias("sum_len"), (F.count(F.lit(1)) / F.greatest(shards, F.lit(1))).alias("avg_shard_samples"),
    )


def sharded(spark: SparkSession, sf: str) -> DataFrame:
    rows = banded(spark, sf).withColumn("num_chunk_bounds", F.when(F.col("total_len") > LIMIT, F.floor((F.col("total_len") - 1) / LIMIT)).otherwise(F.lit(0)))
    return readers.with_shards(rows, ["doc_id"], SHARD)


_SHARDED = BANDED + """, sharded AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS shard_id, (row_number() OVER (ORDER BY doc_id) - 1) % 128 AS sample_idx,
  CASE WHEN total_len > 2048 THEN (total_len - 1) // 2048 ELSE 0 END AS nb FROM banded)"""


@query("q_shard_index", f"""WITH {_SHARDED}, sized AS (SELECT *, 28 + 4 * (total_len + nb) AS record_nbytes FROM sharded)
SELECT shard_id::BIGINT AS shard_id, sample_idx::BIGINT AS sample_idx, (64 + 16 * count(*) OVER (PARTITION BY shard_id) + sum(record_nbytes) OVER (PARTITION BY shard_id ORDER BY sample_idx) - record_nbytes)::BIGINT AS data_offset,
  record_nbytes::BIGINT AS record_nbytes, band::INTEGER AS band FROM sized""")
def q_shard_index(spark: SparkSession, sf: str) -> DataFrame:
    return readers.shard_index(sharded(spark, sf))


@query("q_shard_round_trip", f"WITH {_SHARDED} SELECT doc_id, total_len, band::INTEGER AS band, shard_id::BIGINT AS shard_id, sample_idx::BIGINT AS sample_idx FROM sharded WHERE shard_id % 2 = 1")
def q_shard_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written, then those of one rank of two read back."""
    path = work_folder(spark)
    rows = sharded(spark, sf)
    readers.write_shards(rows, path)
    back = readers.read_shards(spark, path).where("shard_id % 2 = 1")
    return back.select("doc_id", "total_len", "band", F.col("shard_id").cast("long").alias("shard_id"), "sample_idx")


@query("q_shard_round_trip_ranks", f"WITH {_SHARDED} SELECT doc_id, total_len, band::INTEGER AS band, shard_id::BIGINT AS shard_id, sample_idx::BIGINT AS sample_idx, (shard_id % 2)::INTEGER AS rank FROM sharded")
def q_shard_round_trip_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """All shards read back, by each of two ranks."""
    path = work_folder(spark)
    readers.write_shards(sharded(spark, sf), path)
    one, two = (readers.read_shards(spark, path).where(f"shard_id % 2 = {r}").withColumn("rank", F.lit(r)) for r in range(2))
    return one.unionByName(two).select("doc_id", "total_len", "band", F.col("shard_id").cast("long").alias("shard_id"), "sample_idx", "rank")


_ASSIGNED = _SHARDED + """, placed AS (SELECT shard_id, row_number() OVER (ORDER BY md5('1234-0-' || shard_id::VARCHAR), shard_id) - 1 AS place FROM (SELECT DISTINCT shard_id FROM sharded)),
assigned AS (SELECT shard_id, place, place % 2 AS rank, place // 2 AS rank_place, place // 2 // 4 AS resident_window FROM placed)"""


@query("q_shard_assign", f"WITH {_ASSIGNED} SELECT shard_id::BIGINT AS shard_id, place::BIGINT AS place, rank::BIGINT AS rank, rank_place::BIGINT AS rank_place, resident_window::BIGINT AS resident_window FROM assigned")
def q_shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return batches.assign_shards(sharded(spark, sf), 2, 4)


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with their rank, resident window and place in the rank's stream."""
    from lenforge.operators.numbering import numbered

    rows = sharded(spark, sf)
    at = rows.join(batches.assign_shards(rows, 2, 4), "shard_id").withColumn("_key", batches.shuffle_key(42, "doc_id"))
    return numbered(at.select("doc_id", "band", "total_len", "rank", "resident_window", "_key"), ["rank"], ["resident_window", "_key", "doc_id"], "stream_pos").drop("_key")


@query("q_exhaustion", f"""WITH {_ASSIGNED}, s AS (SELECT band, rank, resident_window, row_number() OVER (PARTITION BY rank ORDER BY resident_window, k, doc_id) - 1 AS stream_pos FROM sharded JOIN assigned USING (shard_id))
SELECT rank::BIGINT AS rank, resident_window::BIGINT AS resident_window, band::INTEGER AS band, count(*)::BIGINT AS n_rows, max(stream_pos)::BIGINT AS last_pos FROM s GROUP BY ALL""")
def q_exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    return batches.exhaustion(streamed(spark, sf))


# --- deriving bands --------------------------------------------------------------------------------------------------


@query("q_prefix_sums", f"WITH {DOCS}, h AS (SELECT total_len AS len, count(*) AS n FROM docs WHERE total_len <= 2048 GROUP BY 1) SELECT len, n::BIGINT AS n, (sum(n) OVER (ORDER BY len))::BIGINT AS cum_n, (sum(n * len) OVER (ORDER BY len))::BIGINT AS cum_len FROM h")
def q_prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    return bands.prefix_sums(bands.histogram(doc_lengths(spark, sf), LIMIT))


_HIST = DOCS + ", h AS (SELECT total_len AS len, count(*) AS n FROM docs WHERE total_len <= 2048 GROUP BY 1), p AS (SELECT len, n, sum(n) OVER (ORDER BY len) AS c, sum(n * len) OVER (ORDER BY len) AS s FROM h)"


@query("q_pad_matrix_k2", f"WITH {_HIST}, t AS (SELECT max(len) AS l, max(c) AS c, max(s) AS s FROM p) SELECT p.len AS edge, (p.len * p.c - p.s + t.l * (t.c - p.c) - (t.s - p.s))::BIGINT AS padding FROM p, t WHERE p.len < t.l")
def q_pad_matrix_k2(spark: SparkSession, sf: str) -> DataFrame:
    return bands.pad_two_bands(bands.histogram(doc_lengths(spark, sf), LIMIT))


def _curve_sql(kmax: int) -> str:
    steps = ["d1 AS (SELECT len AS j, c, s, len * c - s AS pad FROM p)"]
    for k in range(2, kmax + 1):
        steps.append(f"d{k} AS (SELECT b.j, b.c, b.s, min(a.pad + b.j * (b.c - a.c) - (b.s - a.s)) AS pad FROM d{k - 1} a JOIN d1 b ON a.j < b.j GROUP BY b.j, b.c, b.s)")
    union = " UNION ALL ".join(f"SELECT {k} AS k, pad FROM d{k} WHERE j = (SELECT max(j) FROM d1)" for k in range(1, kmax + 1))
    return f"WITH {_HIST}, {', '.join(steps)}, curve AS ({union})"


@query("q_padding_curve", _curve_sql(4) + " SELECT k::INTEGER AS k, pad::BIGINT AS padding FROM curve")
def q_padding_curve(spark: SparkSession, sf: str) -> DataFrame:
    lengths, counts = bands.to_arrays(bands.histogram(doc_lengths(spark, sf), LIMIT))
    return spark.createDataFrame([(k + 1, p) for k, (p, _) in enumerate(bands.optimal_curve(lengths, counts, 4))], "k int, padding bigint")


@query("q_elbow", _curve_sql(4) + """, g AS (SELECT k, (lag(pad) OVER (ORDER BY k) - pad) / (SELECT pad FROM curve WHERE k = 1)::DOUBLE AS gain FROM curve)
SELECT coalesce(min(k) - 1, 4)::INTEGER AS k_elbow FROM g WHERE gain < 0.05""")
def q_elbow(spark: SparkSession, sf: str) -> DataFrame:
    lengths, counts = bands.to_arrays(bands.histogram(doc_lengths(spark, sf), LIMIT))
    return spark.createDataFrame([(bands.elbow([p for p, _ in bands.optimal_curve(lengths, counts, 4)], 0.05),)], "k_elbow int")


# The settings of derive().
KMAX, GAIN = 6, 0.05


def _curve(spark: SparkSession, sf: str) -> list[int]:
    lengths, counts = bands.to_arrays(bands.histogram(doc_lengths(spark, sf), LIMIT))
    return [p for p, _ in bands.optimal_curve(lengths, counts, KMAX)]


@query("q_padding_curve_full", _curve_sql(KMAX) + " SELECT k::INTEGER AS k, pad::BIGINT AS padding FROM curve")
def q_padding_curve_full(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_curve(spark, sf), 1)), "k int, padding bigint")


@query("q_elbow_full", _curve_sql(KMAX) + f""", g AS (SELECT k, (lag(pad) OVER (ORDER BY k) - pad) / (SELECT pad FROM curve WHERE k = 1)::DOUBLE AS gain FROM curve)
SELECT coalesce(min(k) - 1, {KMAX})::INTEGER AS k_elbow FROM g WHERE gain < {GAIN}""")
def q_elbow_full(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(bands.elbow(_curve(spark, sf), GAIN),)], "k_elbow int")


def config(spark: SparkSession, sf: str) -> bands.BandConfig:
    rows = doc_lengths(spark, sf)
    t = rows.agg(F.count_if(F.col("total_len") > LIMIT).alias("chunked"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-t["n"] // SHARD))
    return bands.derive(bands.histogram(rows, LIMIT), t["chunked"], t["n"] / shards)


@query("q_band_config")
def q_band_config(spark: SparkSession, sf: str) -> DataFrame:
    c = config(spark, sf)
    row = (c.k_elbow, c.k_feasible, c.k_final, c.curve, c.edges, c.cutoffs, c.populations, c.chunked, c.padding_before_guard, c.padding)
    return spark.createDataFrame([row], "k_elbow int, k_feasible int, k_final int, padding_curve map<int,bigint>, band_edges array<int>, internal_cutoffs array<int>, band_populations array<bigint>, chunked_population bigint, padding_before_guard bigint, total_padding_tokens bigint")


@query("q_band_weights", f"""WITH {BANDED} SELECT band::INTEGER AS band, count(*)::BIGINT AS population, count(*) / (SELECT count(*) FROM banded)::DOUBLE AS weight FROM banded GROUP BY band""")
def q_band_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = batches.band_counts(banded(spark, sf))
    c = bands.BandConfig(0, 0, 3, {}, [*CUTOFFS, LIMIT], [n.get(b, 0) for b in range(3)], n.get(3, 0), 0, 0)
    rows = [(b, p, w) for b, p, w in zip(range(4), [*c.populations, c.chunked], c.weights, strict=True) if p]
    return spark.createDataFrame(rows, "band int, population bigint, weight double")


SYNTHETIC = 2000


def _words_sql(first: str, n: str) -> str:
    table = "[" + ", ".join(f"'{w}'" for w in synthetic.WORDS.split()) + "]"
    return f"array_to_string(list_transform(range({n}), lambda i: {table}[(({first} + i * (({first} % 13) * 2 + 1) + i * i // 7) % {len(synthetic.WORDS.split())} + 1)::INTEGER]), ' ')"


def _corpus_sql(mix: str) -> str:
    part = lambda at: f"('0x' || substr(h, {at}, 6))::BIGINT"
    size = lambda k: "CASE kind " + " ".join(f"WHEN '{c}' THEN {v[k]}" for c, v in synthetic.KINDS.items()) + " END"
    opening = "[" + ", ".join(f"'{o}'" for o in synthetic.OPENINGS) + "]"
    return f"""SELECT '{mix}' AS mix, id, {opening}[({part(7)} % {len(synthetic.OPENINGS)} + 1)::INTEGER] || ' ' || {_words_sql(part(13), size(0))} AS instruction, '' AS input, {_words_sql(part(19), size(1))} AS output
FROM (SELECT *, substr('{synthetic.MIXES[mix]}', ({part(1)} % 10 + 1)::INTEGER, 1) AS kind FROM (SELECT range AS id, md5('1234-{mix}-' || range::VARCHAR) AS h FROM range({SYNTHETIC})))"""


@query("q_synth_corpus", " UNION ALL ".join(map(_corpus_sql, synthetic.MIXES)))
def q_synth_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each synthetic corpus, with their texts; the number of records is a parameter of the generator."""
    one, two, three = (synthetic.corpus(spark, m, SYNTHETIC).withColumn("mix", F.lit(m)) for m in synthetic.MIXES)
    return one.unionByName(two).unionByName(three)
