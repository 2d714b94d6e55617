"""Build, derive and proxy over small sources; pools of the pipeline against the schedule's rules."""

import json

import numpy as np
import pytest

from lenforge import __main__ as cli
from lenforge.functions import encoding
from lenforge.functions import lengths as L
from lenforge.pipeline import DataPipeline, PipelineConfig, epoch_report, run_loader_only, summed
from lenforge.sources import readers, synthetic

META = "format_version magic tokenizer vocab_size bos_id eos_id pad_id max_seq_length bands option_b_window num_shards num_samples band_counts length_histogram case_codes band_codes loss_mask_rule zone_order_in_record source_stats build_seconds".split()
BANDS = "k_elbow k_feasible k_final padding_curve band_edges internal_cutoffs band_populations chunked_population total_samples_all_bands profile_bands profile_mix profile_is_chunked category_weights total_padding_tokens avg_shard_samples notes".split()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("build")
    synthetic.emit(spark, f"{at}/big", "big", 300)
    synthetic.emit(spark, f"{at}/tiny", "tiny", 100)
    (at / "catalog.json").write_text(json.dumps([{"name": m, "path": f"{at}/{m}"} for m in ("big", "tiny")]))
    meta = cli.main(["build", "--config", f"{at}/catalog.json", "--out", f"{at}/out", "--max-seq-length", "1024", "--shard-size", "50", "--band-short-max", "128", "--band-medium-max", "512"])
    return at, meta


def test_build_and_derive(built):
    at, meta = built
    assert list(meta) == META and meta["num_samples"] == 400 == sum(meta["band_counts"].values()) and meta["num_shards"] == 8 and meta["source_stats"] == {"read": 400, "kept": 400}
    assert sum(meta["length_histogram"].values()) + meta["band_counts"][3] == 400 and meta["band_counts"][3] > 0
    stored = json.loads((at / "out/meta.json").read_text())
    assert stored["length_histogram"] == {str(k): v for k, v in meta["length_histogram"].items()}
    config = cli.main(["derive", "--meta", f"{at}/out/meta.json", "--batch-size", "4"])
    assert list(config) == BANDS and abs(sum(config["category_weights"]) - 1) < 1e-6 and json.loads((at / "out/band_config.json").read_text())["k_final"] == config["k_final"]


def test_pools(spark, built):
    at, meta = built
    for extra in ({}, {"baseline": True}, {"profile_bands": [[0, 0], [1, 1], [2, 2], [3, 3]], "profile_is_chunked": [False, False, False, True]}):
        seen, pools = 0, []
        for rank in range(2):
            pipe = DataPipeline(spark, PipelineConfig(shards=f"{at}/out/shards", rank=rank, world_size=2, B=8, band_cutoffs=[128, 512], band_max_seq_len=1024, option_b_window=1024, num_epochs=1, **extra))
            pipe.start()
            while (pool := pipe.next_pool()) is not None:
                pools.append(pool)
                seen += len(pool)
                assert pool.input_ids.dtype == np.int64 and pool.padded_width % 8 == 0 and (pool.labels[pool.attention_mask == 0] == -100).all() and (pool.input_ids[pool.attention_mask == 0] == 0).all()
                assert pool.is_chunked is False or pool.padded_width == 1024
                kept = np.minimum(np.array(pool.prompt_len) + pool.context_len + pool.response_len, 1024 if pool.is_chunked else 10**9)
                assert pool.attention_mask.sum(axis=1).tolist() == kept.tolist() and pool.real_tokens == kept.sum()
            assert pipe.streamer_done() and pipe.queue_size() == 0 and pipe.formation_count() and len(pipe.empty_alerts()) == 4
            pipe.stop()
        assert seen == 400
        if extra.get("baseline"):
            assert all(p.profile_index == -1 and p.baseline and not p.is_chunked for p in pools)


def test_endless_epochs_and_the_loop_without_training(spark, built):
    at, _ = built
    pipe = DataPipeline(spark, PipelineConfig(shards=f"{at}/out/shards", B=64, band_cutoffs=[128, 512], band_max_seq_len=1024, option_b_window=1024))
    pipe.start()
    summary, rows = run_loader_only(pipe, max_batches=12)
    assert summary["batches"] == 12 == len(rows) and pipe.samples_streamed() > 400 and summary["tokens_per_sec"] > 0
    pipe.stop()
    assert pipe.next_pool() is None


def test_reports(spark, built):
    at, _ = built
    report = cli.main(["proxy", "--shards", f"{at}/out", "--B", "8", "--out", f"{at}/report.json"])
    assert report["ours"]["samples"] == 400 == report["baseline"]["samples"] and json.loads((at / "report.json").read_text())["B"] == 8
    cfg = PipelineConfig(shards=f"{at}/out/shards", world_size=2, B=8, band_cutoffs=[128, 512], band_max_seq_len=1024, option_b_window=1024)
    both = summed([epoch_report(DataPipeline(spark, PipelineConfig(**{**vars(cfg), "rank": r})), "ours") for r in range(2)])
    assert both["samples"] == 400 and both["padded_tokens"] == both["real_tokens"] + both["pad_tokens"]
    assert epoch_report(DataPipeline(spark, cfg), "ours", max_pools=3)["pools"] == 3


def test_tokenizers(spark):
    assert encoding.Tokenizer("t", None, 9, 1, 2).padding == 2 and encoding.WORDS.padding == 0
    rows = spark.createDataFrame([("do it", "  ", "so so"), ("", None, "x")], "instruction string, context string, response string")
    got = encoding.encode_zones(rows).collect()
    assert got[0].prompt_ids[0] == 1 and got[0].context_ids == [] and got[0].response_ids[-1] == 2 and got[0].response_ids[2] == got[0].response_ids[3]
    assert [len(r.prompt_ids) for r in encoding.encode_zones(rows, add_bos=False).collect()] == [4, 2]
    counts = rows.select(*(c.alias(k) for k, c in L.zone_lengths().items())).collect()
    assert [tuple(c) for c in counts] == [(r.prompt_len, r.context_len, r.response_len) for r in got]


def test_splits_caps_and_streams(spark, tmp_path):
    for bad in ("train[:10%]", "train[-5:]", "a b"):
        with pytest.raises(ValueError):
            readers.split_slice(bad)
    assert readers.split_slice(None) == (None, 0, None)
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(json.dumps({"instruction": f"{k}-{i}", "output": "y"}) for i in range(5)))
    from lenforge.sources.catalog import spec

    s = spec({"name": "a", "path": str(tmp_path), "limit": 7})
    got = [r.instruction for r in readers.merged(spark, [s]).collect()]
    assert sorted(got) == sorted([f"0-{i}" for i in range(5)] + ["1-0", "1-1"])
    hub = tmp_path / "hub" / "train"
    spark.createDataFrame([(f"q{i}", "", "r", None) for i in range(6)], "instruction string, input string, output string, response string").coalesce(1).write.parquet(str(hub))
    take = lambda split: sorted(r.instruction for r in readers.merged(spark, [spec({"name": "h", "path": str(tmp_path / "hub"), "source": "hf", "split": split, "streaming": True})]).collect())
    assert take("train[:2]") == ["q0", "q1"] and take("train[4:]") == ["q4", "q5"] and len(take("train")) == 6
    assert readers.stream(spark, spec({"name": "h", "path": str(tmp_path / "hub"), "source": "hf", "split": "train"}), "alpaca").isStreaming
    with pytest.raises(ValueError):
        readers.stream(spark, spec({"name": "h", "path": "x", "source": "hf", "split": "train[:2]"}), "alpaca")
