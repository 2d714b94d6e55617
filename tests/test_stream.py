import hashlib
import os

from pyspark.sql import functions as F

from lenforge.streaming import batcher


def model(shards, window, batch):
    """{(batch_id, row_idx, doc_id, window)} of lists of (doc_id, band), a window at a time."""
    out, queues, n = set(), {}, 0
    for n in range(0, len(shards), window):
        w, made = n // window, {}
        for doc, band in sorted((r for s in shards[n : n + window] for r in s), key=lambda r: hashlib.md5(f"42-{r[0]}".encode()).hexdigest()):
            q = queues.setdefault(band, [])
            q.append(doc)
            if len(q) == batch:
                out |= {(f"{w}-{band}-{made.get(band, 0)}", i, d, w) for i, d in enumerate(q)}
                made[band], queues[band] = made.get(band, 0) + 1, []
    end = -(-len(shards) // window)
    return out | {(f"end-{b}-0", i, d, end) for b, q in queues.items() for i, d in enumerate(q)}


def counted(monkeypatch):
    calls, own = [], batcher.WindowBatcher.__call__
    monkeypatch.setattr(batcher.WindowBatcher, "__call__", lambda self, rows, n: (calls.append(n), own(self, rows, n))[1])
    return calls


def test_a_micro_batch_holds_many_windows(spark, tmp_path, monkeypatch):
    # Band 2 is so thin that its rows wait for several windows.
    shards = [[(d, 2 if d % 11 == 0 else d % 2) for d in range(s * 25, s * 25 + 25 - s)] for s in range(11)]
    for s, rows in enumerate(shards):
        path = tmp_path / f"files/s{10 - s}"  # names run against the stream's order
        spark.createDataFrame([(d, b, 7) for d, b in rows], "doc_id bigint, band int, total_len bigint").coalesce(1).write.parquet(str(path))
        for p in path.glob("*.parquet"):
            os.utime(p, (1_700_000_000 + s, 1_700_000_000 + s))
    for i, lo in enumerate(range(0, 11, 4)):  # shards of a file told apart by a column
        path = tmp_path / f"columns/s{i}"
        spark.createDataFrame([(d, b, 7, s) for s in range(lo, min(11, lo + 4)) for d, b in shards[s]], "doc_id bigint, band int, total_len bigint, shard_id bigint").coalesce(1).write.parquet(str(path))
        for p in path.glob("*.parquet"):
            os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    want, calls, kind = model(shards, 2, 8), counted(monkeypatch), "doc_id bigint, band int, total_len bigint"
    assert sum(len(s) for s in shards) == len(want)
    ways = [("files", kind, {}, 1), ("files", kind, {"files": 4}, 3), ("columns", kind + ", shard_id bigint", {"shard": "shard_id", "files": 1}, 3)]
    for i, (folder, schema, more, micro_batches) in enumerate(ways):
        calls.clear()
        got = batcher.run(spark, str(tmp_path / folder / "*"), schema, str(tmp_path / f"out{i}"), str(tmp_path / f"state{i}"), 2, 8, **more)
        assert {(r.batch_id, r.row_idx, r.doc_id, r.window) for r in got.collect()} == want
        assert got.count() == len(want) and len(calls) == micro_batches


def test_q_stream_batches_takes_many_windows_at_once(spark, tmp_path, monkeypatch):
    from lenforge.catalogue_of_queries import QUERIES

    calls = counted(monkeypatch)
    spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', cast(id % 5 * 400 + 1 as int))").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["q_stream_batches"](spark, str(tmp_path)).collect()
    assert len(calls) == 1  # six windows
    assert sum(r.n_rows for r in got) == 3000 and {int(r.batch_id.split("-")[0]) for r in got if r.n_rows == 32} == set(range(6))
    assert all(r.n_rows == 32 or r.batch_id.startswith("end") for r in got)


def test_q_stream_totals_equals_its_sql_over_many_windows(spark, tmp_path, monkeypatch):
    import duckdb

    from lenforge.catalogue_of_queries import ORACLES, QUERIES

    calls = counted(monkeypatch)
    spark.range(3001).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('a ', cast(id % 5 * 600 + id % 2 as int)) END").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["q_stream_totals"](spark, str(tmp_path))
    names = ["band", "n_rows", "distinct_rows", "ids", "batches"]
    rows = sorted(tuple(r[n] for n in names) for r in got.collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == sorted(con.sql(f"select {', '.join(names)} from ({ORACLES['q_stream_totals']})").fetchall()) and len(rows) == 4
    assert len(calls) == 1  # five windows


def test_q_stream_totals_counts_the_words_of_a_text_once(spark, tmp_path, monkeypatch):
    from lenforge.catalogue_of_queries import QUERIES
    from lenforge.functions import lengths

    texts = spark.sparkContext.accumulator(0)

    def n_words(text):
        texts.add(1)
        return None if text is None else len(text.split())

    monkeypatch.setattr(lengths, "n_words", F.udf(n_words, "int"))
    spark.range(700).selectExpr("id AS doc_id", "CASE WHEN id % 7 > 1 THEN repeat('a ', cast(id % 5 * 600 as int)) WHEN id % 7 = 1 THEN ' ' END AS text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.band: r.n_rows for r in QUERIES["q_stream_totals"](spark, str(tmp_path)).collect()}
    assert got == {1: 200, 2: 100, 3: 100} and texts.value == 700
