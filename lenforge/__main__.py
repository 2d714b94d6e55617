"""Command lines: python -m lenforge build | derive | proxy."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenforge.functions import encoding
from lenforge.functions import lengths as L
from lenforge.operators import bands
from lenforge.pipeline import DataPipeline, PipelineConfig, epoch_report
from lenforge.session import build_session, written
from lenforge.sources import readers
from lenforge.sources.catalog import load_catalog


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A JSON file on any file system the session knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def metadata(rows: DataFrame, read: int, tok: encoding.Tokenizer, max_seq_length: int, short_max: int, medium_max: int, window: int, seconds: float) -> dict:
    """What a build states of its shards; one aggregation each for the counts, the bands and the histogram (at most ``max_seq_length`` lengths)."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.max("shard_id"), F.lit(-1)) + 1).alias("shards")).first()
    counts = {r["band"]: r["count"] for r in rows.groupBy("band").count().collect()}
    lengths, n = bands.to_arrays(bands.histogram(rows.where("is_chunked = 0"), max_seq_length))
    return {
        "format_version": readers.VERSION, "magic": readers.MAGIC.decode(), "tokenizer": tok.name, "vocab_size": tok.vocab_size, "bos_id": tok.bos_id, "eos_id": tok.eos_id, "pad_id": tok.padding, "max_seq_length": max_seq_length,
        "bands": {"short_max": short_max, "medium_max": medium_max, "long_max": max_seq_length}, "option_b_window": window, "num_shards": t["shards"], "num_samples": t["n"], "band_counts": {b: counts.get(b, 0) for b in L.BANDS},
        "length_histogram": dict(zip(lengths.tolist(), n.tolist(), strict=True)), "case_codes": {v: k for k, v in L.CASES.items()}, "band_codes": {v: k for k, v in L.BANDS.items()}, "loss_mask_rule": "loss on last response_len tokens only", "zone_order_in_record": ["prompt", "context", "response"],
        "source_stats": {"read": read, "kept": t["n"]}, "build_seconds": round(seconds, 1),
    }


def build(spark: SparkSession, config: str, out: str, tokenizer: str = "words", max_seq_length: int = 2048, shard_size: int = 8192, band_short_max: int = 512, band_medium_max: int = 1536, add_bos: bool = True, add_eos: bool = True) -> dict:
    """Catalog to shards: reads, parses, encodes, classifies and writes; gives the metadata, which lies beside the shards."""
    began, specs, tok = time.perf_counter(), load_catalog(config), encoding.by_name(tokenizer)
    rows = written(readers.merged(spark, specs).withColumn("sample_id", F.monotonically_increasing_id()))
    read = readers.n_read(spark, specs)
    ids = encoding.classified(encoding.encode_zones(rows, tok, add_bos, add_eos), max_seq_length, band_short_max, band_medium_max).drop("instruction", "context", "response")
    readers.write_shards(readers.with_shards(ids, ["sample_id"], shard_size), f"{out}/shards")
    meta = metadata(spark.read.parquet(f"{out}/shards"), read, tok, max_seq_length, band_short_max, band_medium_max, max_seq_length, time.perf_counter() - began)
    write_json(spark, f"{out}/meta.json", meta)
    return meta


def derive(spark: SparkSession, meta_path: str, out: str | None = None, window: int = 4, batch: int = 32, kmax: int = 6, elbow: float = 0.05, least: float = 0.02, safety: float = 3.0) -> dict:
    """Band configuration of a build's histogram, written beside it unless told otherwise."""
    meta = read_json(spark, meta_path)
    hist = spark.createDataFrame([(int(k), v) for k, v in meta["length_histogram"].items()], "len bigint, n bigint")
    chunked, average = int(meta["band_counts"]["3"]), meta["num_samples"] / max(1, meta["num_shards"])
    c = bands.derive(hist, chunked, average, window, batch, kmax, elbow, least, safety)
    k = len(c.edges)
    config = {
        "k_elbow": c.k_elbow, "k_feasible": c.k_feasible, "k_final": c.k_final, "padding_curve": c.curve, "band_edges": c.edges, "internal_cutoffs": c.cutoffs, "band_populations": c.populations, "chunked_population": c.chunked, "total_samples_all_bands": sum(c.populations) + c.chunked,
        "profile_bands": [[b, b] for b in range(k + 1)], "profile_mix": [[1.0, 0.0]] * (k + 1), "profile_is_chunked": [b == k for b in range(k + 1)], "category_weights": c.weights, "total_padding_tokens": c.padding_before_guard, "avg_shard_samples": average,
        "notes": {"max_seq_length": meta["max_seq_length"], "num_samples": meta["num_samples"], "num_shards": meta["num_shards"]},
    }
    write_json(spark, out or meta_path.rsplit("/", 1)[0] + "/band_config.json", config)
    return config


def proxy(spark: SparkSession, shards: str, out: str, cfg: PipelineConfig, alpha: float = 1.0, beta: float = 0.0, gamma: float = 0.0) -> dict:
    """The category schedule and the rotation over bands on one build, as a report."""
    meta = read_json(spark, f"{shards}/meta.json")
    cfg = replace(cfg, shards=f"{shards}/shards", band_cutoffs=[meta["bands"]["short_max"], meta["bands"]["medium_max"]], band_max_seq_len=meta["max_seq_length"], option_b_window=meta["option_b_window"], pad_id=meta["pad_id"])
    ours, base = (epoch_report(DataPipeline(spark, replace(cfg, baseline=b)), "baseline" if b else "round_robin", alpha, beta, gamma) for b in (False, True))
    report = {"ours": ours, "baseline": base, "world_size": cfg.world_size, "B": cfg.B, "resident_window": cfg.resident_window, "proxy_model": {"alpha": alpha, "beta": beta, "gamma": gamma}}
    write_json(spark, out, report)
    return report


def main(argv: list[str] | None = None) -> dict:
    top = argparse.ArgumentParser(prog="lenforge")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    for name in ("--config", "--out"):
        b.add_argument(name, required=True)
    b.add_argument("--tokenizer", default="words")
    for name, value in (("--max-seq-length", 2048), ("--shard-size", 8192), ("--workers", 8), ("--band-short-max", 512), ("--band-medium-max", 1536)):
        b.add_argument(name, type=int, default=value)
    b.add_argument("--no-bos", action="store_true")
    b.add_argument("--no-eos", action="store_true")
    d = sub.add_parser("derive")
    d.add_argument("--meta", required=True)
    d.add_argument("--out")
    for name, value in (("--resident-window", 4), ("--batch-size", 32), ("--kmax", 6)):
        d.add_argument(name, type=int, default=value)
    for name, value in (("--elbow", 0.05), ("--min-band-frac", 0.02), ("--window-safety", 3.0)):
        d.add_argument(name, type=float, default=value)
    p = sub.add_parser("proxy")
    p.add_argument("--shards", required=True)
    for name, value in (("--B", 32), ("--window", 4), ("--occupancy", 50_000), ("--pad-to-multiple", 8), ("--prefetch-workers", 3), ("--ring-capacity", 4), ("--seed", 1234)):
        p.add_argument(name, type=int, default=value)
    for name, value in (("--alpha", 1.0), ("--beta", 0.0), ("--gamma", 0.0)):
        p.add_argument(name, type=float, default=value)
    p.add_argument("--out", default="proxy_benchmark.json")
    a = top.parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session("lenforge", getattr(a, "workers", None))
    if a.command == "build":
        return build(spark, a.config, a.out, a.tokenizer, a.max_seq_length, a.shard_size, a.band_short_max, a.band_medium_max, not a.no_bos, not a.no_eos)
    if a.command == "derive":
        return derive(spark, a.meta, a.out, a.resident_window, a.batch_size, a.kmax, a.elbow, a.min_band_frac, a.window_safety)
    cfg = PipelineConfig(B=a.B, resident_window=a.window, max_queue_occupancy=a.occupancy, pad_to_multiple=a.pad_to_multiple, prefetch_workers=a.prefetch_workers, ring_capacity=a.ring_capacity, seed=a.seed)
    return proxy(spark, a.shards, a.out, cfg, a.alpha, a.beta, a.gamma)


if __name__ == "__main__":
    print(json.dumps({k: v for k, v in main().items() if k != "length_histogram"}, indent=2))
