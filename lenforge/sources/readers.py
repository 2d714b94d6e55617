"""Readers of instruction data sets, their merge, and the shard table with its index and metadata."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lenforge.operators.numbering import numbered
from lenforge.operators.parsers import parse
from lenforge.sources.catalog import DatasetSpec

TURN = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "from", "content", "value")])
RAW_SCHEMAS = {
    "alpaca": T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output", "response")]),
    "chat": T.StructType([T.StructField(c, T.ArrayType(TURN)) for c in ("conversations", "messages")]),
}


def raw_schema(spec: DatasetSpec, fmt: str) -> T.StructType:
    if fmt != "pair":
        return RAW_SCHEMAS[fmt]
    names = dict.fromkeys(c for c in (spec.prompt_field, spec.response_field, spec.context_field) if c)
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def split_slice(split: str | None) -> tuple[str | None, int, int | None]:
    """("train", 0, 2000) of "train[:2000]"; no split is all of the path. Percentages and places counted from the end are refused."""
    if not split:
        return None, 0, None
    m = re.fullmatch(r"(\w+)(?:\[(\d*):(\d*)\])?", split)
    if not m:
        raise ValueError(f"unknown split {split!r}")
    return m[1], int(m[2] or 0), int(m[3]) if m[3] else None


def scan(spark: SparkSession, spec: DatasetSpec, fmt: str) -> DataFrame:
    """The raw records of a source, columns by the format; bad JSON fails the read."""
    schema = raw_schema(spec, fmt)
    if spec.source == "hf":
        # A mirrored hub data set: one folder of Parquet files per split.
        name, lo, hi = split_slice(spec.split)
        path = f"{spec.path}/{name}" if name else spec.path
        return capped(spark.read.schema(schema).parquet(path), None if hi is None else hi - lo, lo)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", spec.source == "json").json(spec.path)


def stream(spark: SparkSession, spec: DatasetSpec, fmt: str) -> DataFrame:
    """The raw records of a hub source as a stream of its files; a stream has no places, so that slices and caps are refused."""
    name, lo, hi = split_slice(spec.split)
    if lo or hi is not None or spec.limit:
        raise ValueError(f"{spec.name}: a stream cannot be cut by places")
    return spark.readStream.schema(raw_schema(spec, fmt)).parquet(f"{spec.path}/{name}" if name else spec.path)


def capped(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset`` in source order: by file, place in the file. None or 0 means all."""
    if not (limit or offset):
        return rows
    place = [F.monotonically_increasing_id()]
    if rows.inputFiles() and rows._jdf.queryExecution().analyzed().children().isEmpty():
        # Straight from files: their names and blocks come first, whatever tasks read them.
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), *place]
    names = [f"_o{i}" for i in range(len(place))]
    ordered = rows.select("*", *(c.alias(n) for c, n in zip(place, names, strict=True))).orderBy(*names)
    out = ordered.offset(offset) if offset else ordered
    return (out.limit(limit) if limit else out).drop(*names)


def capped_by(rows: DataFrame, by: str, order: list[str], caps: DataFrame) -> DataFrame:
    """The first rows of each source in ``order``, up to its cap; ``caps``: (by, row_limit), a row per source, where null and 0 mean all."""
    ranked = numbered(rows.where(F.col(by).isNotNull()), [by], order, "_rank")
    return ranked.join(caps, by).where("coalesce(row_limit, 0) = 0 OR _rank < row_limit").drop("_rank", "row_limit")


def merged(spark: SparkSession, specs: list[DatasetSpec]) -> DataFrame:
    """All sources parsed to (dataset, instruction, context, response), as one bag; a source marked as streaming is read lazily, like all."""
    from lenforge.sources.catalog import FORMATS

    out = None
    for s in specs:
        fmt = FORMATS[s.format]
        rows = parse(capped(scan(spark, s, fmt), s.limit), fmt, s.name, s.prompt_field, s.response_field, s.context_field)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no data sets")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def n_read(spark: SparkSession, specs: list[DatasetSpec]) -> int:
    """Records of all sources before parsing."""
    from lenforge.sources.catalog import FORMATS

    return sum(capped(scan(spark, s, FORMATS[s.format]), s.limit).count() for s in specs)


# --- shards ----------------------------------------------------------------------------------------------------------


def with_shards(rows: DataFrame, order: list[str], shard_size: int) -> DataFrame:
    """Adds shard_id and sample_idx, by the rank in ``order``."""
    ranked = numbered(rows, [], order, "_rank")
    return ranked.withColumn("shard_id", F.floor(F.col("_rank") / shard_size)).withColumn("sample_idx", F.col("_rank") % shard_size).drop("_rank")


def record_bytes(total: str = "total_len", bounds: str = "num_chunk_bounds"):
    """Bytes of a binary record: seven 32-bit fields, the ids, the bounds."""
    return 28 + 4 * (F.col(total) + F.col(bounds))


def shard_index(rows: DataFrame) -> DataFrame:
    """(shard_id, sample_idx, data_offset, record_nbytes, band): each shard is bounded by its size, so a window per shard is bounded too."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("shard_id")
    before = F.sum("record_nbytes").over(w.orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("record_nbytes")
    sized = rows.withColumn("record_nbytes", record_bytes())
    header = 64 + 16 * F.count(F.lit(1)).over(w)
    return sized.select("shard_id", "sample_idx", (header + before).alias("data_offset"), "record_nbytes", "band")


#: Shards of a folder: few enough for a task, many enough that folders do not outnumber what a file system lists.
FOLDER_SHARDS = 64


def write_shards(rows: DataFrame, path: str, per_folder: int = FOLDER_SHARDS) -> None:
    """Folders of ``per_folder`` shards, a file each, sorted: a reader prunes to the folders of its shards, and to their rows by statistics."""
    foldered = rows.withColumn("folder", F.floor(F.col("shard_id") / per_folder))
    foldered.repartition("folder").sortWithinPartitions("folder", "shard_id", "sample_idx").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_shards(spark: SparkSession, path: str, shards: list[int] | None = None, per_folder: int = FOLDER_SHARDS) -> DataFrame:
    rows = spark.read.parquet(path)
    if shards is not None:
        rows = rows.where(F.col("folder").isin(sorted({s // per_folder for s in shards})) & F.col("shard_id").isin(shards))
    return rows.drop("folder")


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, n_rows) in order."""
    return spark.read.parquet(path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("shard_id")


_HEADER, _ROW, _RECORD = struct.Struct("<4sIIIII40x"), struct.Struct("<QII"), struct.Struct("<7I")
MAGIC, VERSION = b"UDSS", 1  # fixed values of the binary format


def encode_shard(rows: list[dict], max_seq_length: int) -> bytes:
    """A binary shard of rows with prompt_ids, context_ids, response_ids, is_chunked, case_code, chunk_bounds, band."""
    blobs = []
    for r in rows:
        zones = [list(r[c] or []) for c in ("prompt_ids", "context_ids", "response_ids")]
        sizes, bounds = [len(z) for z in zones], list(r["chunk_bounds"] or [])
        head = _RECORD.pack(*sizes, sum(sizes), int(r["is_chunked"]), int(r["case_code"]), len(bounds))
        ids = [x for z in zones for x in z]
        blobs.append(head + struct.pack(f"<{len(ids)}i", *ids) + struct.pack(f"<{len(bounds)}I", *bounds))
    at, index = _HEADER.size + _ROW.size * len(blobs), b""
    for r, b in zip(rows, blobs, strict=True):
        index += _ROW.pack(at, len(b), int(r["band"]))
        at += len(b)
    return _HEADER.pack(MAGIC, VERSION, len(blobs), max_seq_length, 0, 4) + index + b"".join(blobs)


def decode_shard(data: bytes) -> list[dict]:
    """The rows of a binary shard; raises ValueError on anything malformed."""
    if len(data) < _HEADER.size:
        raise ValueError("shard shorter than its header")
    magic, version, n, _, _, _ = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard, or of another version")
    if len(data) < _HEADER.size + n * _ROW.size:
        raise ValueError("index out of bounds")
    out = []
    for i in range(n):
        at, size, band = _ROW.unpack_from(data, _HEADER.size + i * _ROW.size)
        if at + size > len(data) or size < _RECORD.size:
            raise ValueError("record out of bounds")
        p, c, r, total, chunked, case, nb = _RECORD.unpack_from(data, at)
        if total != p + c + r or size != _RECORD.size + 4 * (total + nb):
            raise ValueError("lengths of a record disagree")
        v = struct.unpack_from(f"<{total}i{nb}I", data, at + _RECORD.size)
        out.append({"sample_idx": i, "band": band, "prompt_ids": list(v[:p]), "context_ids": list(v[p : p + c]), "response_ids": list(v[p + c : total]), "is_chunked": chunked, "case_code": case, "chunk_bounds": list(v[total:])})
    return out


SHARD_SCHEMA = "path string, sample_idx int, band int, prompt_ids array<int>, context_ids array<int>, response_ids array<int>, is_chunked int, case_code int, chunk_bounds array<int>"


def read_binary_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of binary shard files, a file a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([{"path": p, **r} for r in decode_shard(data)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SHARD_SCHEMA)
