"""Problem 3: cutting oversized token rows into overlapping pieces at natural boundaries.

The ids of prompt, context and response, end to end, are first cut into atoms at every natural boundary; a stretch without
one is cut at the size limit. All pairs of neighbouring atoms lie in a heap, weakest boundary first, and are merged while
the merged size plus the overlap fits the limit, so that the cuts that remain are the strongest ones.

Pieces are half-open ranges of offsets. Each but the first begins ``chunk_overlap`` ids before the end of the one before it.
chunk_bounds are the ends of all pieces but the last.

Defined results: a null id array counts as empty; null ids inside count as ordinary pieces of words; a limit that is null or below 1
means no limit; an overlap that is null or negative is 0, and one not below the limit is taken as limit − 1; rows of unknown config
are not cut (their limit is unknown); rows within the limit give no piece; of a row delivered repeatedly the earliest loaded counts (of equal
times the one of least hash), even if only another one is over the limit. Stored lengths, flags, codes and bounds are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Strength of the boundary after a token with this mark; zone marks and list items have theirs before the token.
AFTER = {"paragraph": 7, "line": 5, "sentence": 4, "clause": 2, "close": 1}
BEFORE = {"zone": 8, "item": 6}
ZONE_JOINT, HARD = 9, 0
#: What a boundary loses inside brackets, quotes or code.
INSIDE = 3


def boundary_strengths(ids: list[int], joints: list[int], marks: dict[int, str]) -> dict[int, int]:
    """Strength of each natural boundary, by offset (a cut there ends a piece before that id)."""
    found: dict[int, int] = {}
    n = len(ids)
    depth, quoted, coded = 0, False, False
    line_start = True
    for i, token in enumerate(ids):
        mark = marks.get(token)
        if mark is None:
            line_start = False
            continue
        inside = depth > 0 or quoted or coded
        if mark == "open":
            depth += 1
        elif mark == "close":
            depth = max(0, depth - 1)
            inside = depth > 0 or quoted or coded
        elif mark == "quote":
            quoted = not quoted
        elif mark == "code":
            coded = not coded
        elif mark == "paragraph":
            # An opening mark that is never closed must not weaken the rest of the row.
            depth, quoted, inside = 0, False, coded
        at, strength = 0, 0
        if mark in BEFORE and (mark == "zone" or line_start):
            at, strength = i, BEFORE[mark]
        elif mark in AFTER:
            at, strength = i + 1, AFTER[mark]
        if strength and 0 < at < n:
            found[at] = max(found.get(at, 0), max(1, strength - INSIDE) if inside else strength)
        line_start = mark in ("line", "paragraph", "zone")
    for at in joints:
        if 0 < at < n:
            found[at] = ZONE_JOINT
    return found


def split_bounds(ids: list[int], joints: list[int], limit: int, overlap: int, marks: dict[int, str]) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of each piece of a row longer than ``limit``."""
    n = len(ids)
    overlap = min(max(overlap, 0), limit - 1)
    room = limit - overlap
    strengths = boundary_strengths(ids, joints, marks)
    ends: list[int] = []
    power: list[int] = []
    at = 0
    for b in [*sorted(strengths), n]:
        while b - at > room:
            at += room
            ends.append(at)
            power.append(HARD)
        if b > at:
            ends.append(b)
            power.append(strengths.get(b, HARD))
            at = b
    m = len(ends)
    starts = [0, *ends[:-1]]
    after, before, alive = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m

    def pair(i: int) -> tuple[int, int, int, int, int]:
        j = after[i]
        # The first piece must be able to hold what it shares with the second.
        strength = -1 if i == 0 and ends[0] < overlap else power[i]
        return strength, ends[j] - starts[i], i, ends[i], ends[j]

    heap = [pair(i) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, end_i, end_j = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= m or ends[i] != end_i or ends[j] != end_j:
            continue
        if size > (limit if i == 0 else room):
            continue
        alive[j] = False
        ends[i], power[i] = ends[j], power[j]
        after[i] = after[j]
        if after[i] < m:
            before[after[i]] = i
            heapq.heappush(heap, pair(i))
        h = before[i]
        if h >= 0:
            heapq.heappush(heap, pair(h))
    kept = [i for i in range(m) if alive[i]]
    if len(kept) > 1 and ends[kept[0]] < overlap:
        # No merge reaches the overlap within the limit: cut the first piece hard at the limit and split what follows.
        rest = split_bounds(ids[limit - overlap :], [j - limit + overlap for j in joints], limit, overlap, marks) if n - limit + overlap > limit else [(0, n - limit + overlap, HARD)]
        return [(0, limit, strengths.get(limit, HARD)), *((s + limit - overlap, e + limit - overlap, p) for s, e, p in rest)]
    return [(max(0, starts[i] - overlap) if i else 0, ends[i], power[i]) for i in kept]


def split_oversized(rows: DataFrame, config: DataFrame, marks: DataFrame) -> DataFrame:
    """(sample_id, config_id, piece_no, piece_start, piece_end, end_strength, is_chunked, case_code, chunk_bounds) of each row over its limit.

    The tables of marks and configs are settings of a build; their sizes are checked before they are sent along.
    """
    limit_rows = 100_000
    known = {r.token_id: r.mark for r in marks.where("token_id IS NOT NULL AND mark IS NOT NULL").select("token_id", "mark").limit(limit_rows + 1).collect()}
    if len(known) > limit_rows:
        raise ValueError("token_marks is larger than a table of settings")
    shared = rows.sparkSession.sparkContext.broadcast(known)
    sizes = config.where("max_seq_length >= 1").select("config_id", F.col("max_seq_length").alias("_limit"), F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)).alias("_overlap")).dropDuplicates(["config_id"])
    zones = ("prompt_ids", "context_ids", "response_ids")
    ids = [F.coalesce(F.col(c), F.array().cast("array<int>")).alias(c) for c in zones]
    total = sum((F.size(c) for c in zones[1:]), F.size(zones[0]))
    at = F.col("loaded_at") if "loaded_at" in rows.columns else F.lit(None).cast("timestamp")
    known_rows = rows.select("sample_id", "config_id", at.alias("_at"), F.xxhash64(*zones).alias("_hash"), *ids).join(sizes, "config_id")
    # Every row is carried to the choice of the earliest, but ids only of rows over the limit leave the scan.
    over = [F.when(total > F.col("_limit"), F.col(c)).alias(c) for c in zones]
    carried = known_rows.select("sample_id", "config_id", "_at", "_hash", "_limit", "_overlap", *over)
    kind = carried.schema["_at"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            cols = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            limits, overlaps = cols["_limit"].to_pylist(), cols["_overlap"].to_pylist()
            cases, cut = [], []
            for row in range(batch.num_rows):
                p, c, r = (cols[k][row].as_py() for k in zones)
                if p is None:
                    cases.append(None)
                    cut.append(None)
                    continue
                half = limits[row] // 2
                cases.append((3 if len(p) + len(c) > half else 2) if len(r) > half else 1)
                pieces = split_bounds(p + c + r, [len(p), len(p) + len(c)], limits[row], overlaps[row], table)
                cut.append([{"piece_start": s, "piece_end": e, "end_strength": w} for s, e, w in pieces])
            kinds = pa.list_(pa.struct([(k, pa.int32()) for k in ("piece_start", "piece_end", "end_strength")]))
            yield pa.RecordBatch.from_arrays([*(cols[k] for k in ("sample_id", "config_id", "_at", "_hash")), pa.array(cases, pa.int32()), pa.array(cut, kinds)], names=["sample_id", "config_id", "_at", "_hash", "case_code", "pieces"])

    schema = f"sample_id bigint, config_id int, _at {kind}, _hash bigint, case_code int, pieces array<struct<piece_start: int, piece_end: int, end_strength: int>>"
    cut = carried.mapInArrow(run, schema)
    first = cut.groupBy("sample_id", "config_id").agg(F.min(F.struct("_at", "_hash", "case_code", "pieces")).alias("_r")).select("sample_id", "config_id", "_r.case_code", "_r.pieces")
    bounds = F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda p: p["piece_end"])
    out = first.where("pieces IS NOT NULL").select("sample_id", "config_id", "case_code", bounds.alias("chunk_bounds"), F.posexplode("pieces").alias("piece_no", "_p"))
    return out.select("sample_id", "config_id", "piece_no", "_p.piece_start", "_p.piece_end", "_p.end_strength", F.lit(1).alias("is_chunked"), "case_code", "chunk_bounds")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return split_oversized(read("tokenized"), read("build_config"), read("token_marks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).groupBy("sample_id", "config_id").agg(F.max("case_code").alias("case_code"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of a row must keep: they cover it from 0 to its end, each within the limit, neighbours share the overlap of the config."""
    w = Window.partitionBy("sample_id", "config_id").orderBy("piece_no")  # the pieces of one row
    config = spark.read.parquet(f"{sf_dir}/build_config.parquet").select("config_id", "max_seq_length", "chunk_overlap")
    p = _pieces(spark, sf_dir).withColumn("_shared", F.lag("piece_end").over(w) - F.col("piece_start")).join(config, "config_id")
    return p.groupBy("sample_id", "config_id").agg(
        F.min("piece_start").cast("long").alias("first_start"), F.max("piece_end").cast("long").alias("last_end"), F.bool_and(F.col("piece_end") - F.col("piece_start") <= F.col("max_seq_length")).alias("within_limit"),
        F.min("_shared").cast("long").alias("least_shared"), F.max("_shared").cast("long").alias("most_shared"),
    )


ORACLES = {
    "p3_found": """
SELECT sample_id, config_id, max(CASE WHEN r > m // 2 AND i > m // 2 THEN 3 WHEN r > m // 2 THEN 2 ELSE 1 END)::INTEGER AS case_code
FROM (SELECT sample_id, config_id, coalesce(len(prompt_ids), 0) + coalesce(len(context_ids), 0) AS i,
             coalesce(len(response_ids), 0) AS r, max_seq_length AS m
      FROM tokenized JOIN build_config USING (config_id))
WHERE i + r > m GROUP BY sample_id, config_id
""",
    "p3_coverage": """
SELECT sample_id, config_id, 0::BIGINT AS first_start, max(n)::BIGINT AS last_end, true AS within_limit, max(least(coalesce(chunk_overlap, 0), m - 1))::BIGINT AS least_shared,
       max(least(coalesce(chunk_overlap, 0), m - 1))::BIGINT AS most_shared
FROM (SELECT sample_id, config_id, coalesce(len(prompt_ids), 0) + coalesce(len(context_ids), 0) + coalesce(len(response_ids), 0) AS n, max_seq_length AS m, chunk_overlap
      FROM tokenized JOIN build_config USING (config_id))
WHERE n > m GROUP BY sample_id, config_id
""",
}
