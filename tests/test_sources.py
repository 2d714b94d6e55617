import json

import pytest
from pyspark.sql import functions as F

from lenforge.operators import parsers
from lenforge.sources import readers
from lenforge.sources.catalog import load_catalog, spec


def test_catalog(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"name": "a", "path": "x", "format": "io", "input_field": "ctx", "split": None}]))
    assert load_catalog(str(p))[0].context_field == "ctx"
    for bad in ({"source": "ftp"}, {"format": "xml"}, {"colour": 1}):
        with pytest.raises(ValueError):
            spec({"name": "a", "path": "x", **bad})
    assert readers.split_slice("train_sft[:2000]") == ("train_sft", 0, 2000)


def test_readers_and_merge(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": " do ", "input": "", "output": "", "response": "\\tdone\\u00a0"}\n\n{"instruction": "x", "output": "  ", "response": "y"}\n{"instruction": "q", "output": "r"}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"question": "why", "answer": "so", "passage": "p"}, {"question": "no answer"}]))
    chat = {"messages": [{"role": "system", "content": "s"}, {"from": "human", "value": "q1"}, {"role": "Tool", "content": " "}, {"role": "user", "content": "q2"}, {"role": "tool", "content": "lost"}, {"from": "gpt", "value": " a "}, {"role": "user", "content": "later"}]}
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [chat, {"conversations": [{"role": "assistant", "content": "first"}]}, {"messages": []}, {"messages": [{"role": "user", "content": "u"}, {"role": "bot", "content": ""}]}])))
    out = readers.merged(spark, [
        spec({"name": "a", "path": str(tmp_path / "a.jsonl")}),
        spec({"name": "b", "path": str(tmp_path / "b.json"), "source": "json", "format": "pair", "prompt_field": "question", "response_field": "answer", "context_field": "passage"}),
        spec({"name": "c", "path": str(tmp_path / "c.jsonl"), "format": "chat"}),
    ])
    assert sorted(map(tuple, out.collect())) == [("a", "do", "", "done"), ("a", "q", "", "r"), ("b", "why", "p", "so"), ("c", "q2", "system: s\nuser: q1", "a")]
    assert readers.capped(out, 2).count() == 2 and readers.capped(out, 0).count() == 4


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "x", "output": "y"}\nnot json\n')
    with pytest.raises(Exception):
        readers.merged(spark, [spec({"name": "a", "path": str(tmp_path / "a.jsonl")})]).collect()


def test_roles(spark):
    got = spark.createDataFrame([("Human",), ("GPT",), ("Critic",), ("system",)], "r string").select(parsers.role(F.col("r"))).collect()
    assert [r[0] for r in got] == ["user", "assistant", "critic", "system"]


def test_binary_codec(spark, tmp_path):
    rows = [{"prompt_ids": [1, 2], "context_ids": None, "response_ids": [3], "is_chunked": 0, "case_code": 0, "chunk_bounds": [], "band": 0}, {"prompt_ids": [9] * 5, "context_ids": [8], "response_ids": [7] * 4, "is_chunked": 1, "case_code": 3, "chunk_bounds": [4, 8], "band": 3}]
    data = readers.encode_shard(rows, 4)
    assert len(data) == 64 + 32 + (28 + 12) + (28 + 48)
    back = readers.decode_shard(data)
    assert back[1]["chunk_bounds"] == [4, 8] and back[0]["context_ids"] == [] and back[1]["band"] == 3
    for bad in (b"short", b"XXXX" + data[4:], data[:-4]):
        with pytest.raises(ValueError):
            readers.decode_shard(bad)
    (tmp_path / "s.bin").write_bytes(data)
    assert readers.read_binary_shards(spark, str(tmp_path / "s.bin")).count() == 2
    assert readers.decode_shard(readers.encode_shard([], 4)) == []


def test_all_alpaca_sources_are_parsed(spark, tmp_path):
    from lenforge.catalogue_of_queries import QUERIES

    spark.createDataFrame([("a", "alpaca"), ("b", "alpaca"), ("c", "chat")], "name string, format string").write.parquet(str(tmp_path / "source_catalog.parquet"))
    rows = [(1, "a", "\tdo ", None, "done "), (2, "b", "do", " x", " y"), (3, "c", "do", "", "z"), (4, "b", "do", "", " \n"), (5, None, "do", "", "z"), (6, "a", None, "", "z")]
    spark.createDataFrame(rows, "sample_id bigint, dataset string, instruction string, context string, response string").write.parquet(str(tmp_path / "raw_samples.parquet"))
    got = sorted(map(tuple, QUERIES["q_alpaca_parse"](spark, str(tmp_path)).collect()))
    assert got == [(1, "a", "do", "", "done"), (2, "b", "do", "x", "y")]


def test_all_shards_are_read_back_and_the_elbow_may_exceed_four(spark, tmp_path):
    from lenforge.catalogue_of_queries import QUERIES

    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 6 * 100 + 100).cast("int")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["q_shard_round_trip_ranks"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(600)) and {(r.shard_id, r["rank"]) for r in got} == {(s, s % 2) for s in range(5)}
    assert QUERIES["q_elbow_full"](spark, str(tmp_path)).first().k_elbow == 6
    assert QUERIES["q_padding_curve_full"](spark, str(tmp_path)).count() == 6
