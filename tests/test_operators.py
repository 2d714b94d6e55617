import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lenforge.functions import lengths as L
from lenforge.operators import bands, batches, costs, select
from lenforge.operators.numbering import numbered
from lenforge.streaming import batcher


def padding(lengths, counts, edges):
    return sum(c * (min(e for e in edges if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bands_are_optimal(hist, kmax):
    lengths, counts = np.array(sorted(hist)), np.array([hist[x] for x in sorted(hist)])
    for k, (pad, edges) in enumerate(bands.optimal_curve(lengths, counts, kmax), 1):
        assert len(edges) == k and padding(lengths, counts, edges) == pad
        assert pad == min(padding(lengths, counts, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], k - 1))


def test_guard_and_elbow():
    lengths, counts = np.array([10, 20, 30, 40]), np.array([100, 1, 100, 1])
    assert bands.guarded([10, 20, 30, 40], lengths, counts, 0.02) == [10, 40]
    assert bands.elbow([100, 50, 49], 0.05) == 2 and bands.elbow([100, 50, 20], 0.05) == 3 and bands.elbow([0], 0.05) == 1
    assert bands.feasible_k(6, 4, 10, 32, 3.0) == 1


def test_numbering_of_a_hot_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("x").alias("g"), (F.col("id") * 7919 % 3001).alias("k"))
    got = numbered(rows, ["g"], ["k"], "r", 5).collect()
    for g in {r.g for r in got}:
        own = sorted((r.k, r.r) for r in got if r.g == g)
        assert [r for _, r in own] == list(range(len(own)))
    assert numbered(rows.where("false"), ["g"], ["k"], "r").count() == 0


def test_collation(spark):
    rows = spark.createDataFrame([("b", 1, [1, 2], [3], [4, 5], 5), ("b", 2, [1] * 6, None, [7] * 5, 11)], "batch_id string, sample_id int, prompt_ids array<int>, context_ids array<int>, response_ids array<int>, total_len int")
    got = {r.sample_id: r for r in batches.collated(rows).collect()}
    assert got[1].width == 16 and got[1].input_ids == [1, 2, 3, 4, 5] + [0] * 11 and sum(got[1].attention_mask) == 5
    assert got[1].labels == [-100] * 3 + [4, 5] + [-100] * 11 and got[2].labels == [-100] * 6 + [7] * 5 + [-100] * 5


def test_chunked_collation(spark):
    rows = spark.createDataFrame([("b", 1, [1] * 4, [2] * 3, [3] * 9, 10), ("b", 2, [1] * 30, [2], [3], 10), ("b", 3, [1] * 12, [2], [3], 10), ("b", 4, [1], None, [3, 4], 10)], "batch_id string, sample_id int, prompt_ids array<int>, context_ids array<int>, response_ids array<int>, budget int")
    got = {r.sample_id: r for r in batches.collated(rows, window="budget").collect()}
    assert all(r.width == len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 16 for r in got.values())
    assert got[1].input_ids == [1] * 4 + [2] * 3 + [3] * 3 + [0] * 6 and got[1].labels == [-100] * 7 + [3] * 3 + [-100] * 6 and sum(got[1].attention_mask) == 10
    assert got[2].input_ids == [1] * 16 and got[2].labels == [-100] * 16
    assert got[3].input_ids == [1] * 12 + [0] * 4 and got[3].labels == [-100] * 16
    assert got[4].input_ids == [1, 3, 4] + [0] * 13 and got[4].labels == [-100, 3, 4] + [-100] * 13


def test_lengths(spark):
    r = spark.createDataFrame([(300, 10, 0)], "t int, p int, c int")
    assert r.select(L.chunk_bounds(F.col("t"), 100)).first()[0] == [100, 200]
    assert r.select(L.case_code(F.col("p"), F.col("c"), F.col("t"), 100)).first()[0] == 2
    assert r.select(L.ratio(F.col("t"), F.col("c"))).first()[0] == 0


def test_cost_fit(spark):
    grid = [(n, w, 0.5 + 2e-6 * n * w + 3e-9 * n * w * w) for n in (2, 8) for w in (128, 256, 1024)]
    f = costs.fit(spark.createDataFrame(grid, "n_rows int, width int, seconds double")).first()
    assert abs(f.d - 0.5) < 1e-6 and abs(f.a - 2e-6) < 1e-10 and abs(f.c - 3e-9) < 1e-13 and f.max_residual < 1e-6
    assert costs.overlap_pct(0, 1) == 0 and costs.overlap_pct(4, 1) == 75 and costs.train_efficiency(3, 1) == 0.75


def test_selection(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "k int, v array<double>")
    d = {r.k: r.s_inter for r in select.diversity(v, "k", "v", v.where("k = 1").select(F.col("v").alias("b")), "b").collect()}
    assert d == {1: 0.0, 2: 5.0}
    assert {r.s_inter for r in select.diversity(v, "k", "v", v.where("false").select(F.col("v").alias("b")), "b").collect()} == {0.0}
    chosen = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (2, 0, 6)], "step int, rank int, key int")
    once = select.commit(chosen.where("false"), chosen, 8)
    assert once.count() == 2 and select.commit(once, chosen, 1).first().key == 6


def test_selection_by_utility_and_diversity(spark):
    rng = np.random.default_rng(3)
    cfg = select.SelectConfig(top=3, capacity=5, project_to=4, stage_one=4, stage_two=2, warm_up=2, alpha=0.7)
    data = [(i, p, [float(x) for x in rng.standard_normal(6)], int(p < 2)) for i in range(64) for p in range(3)]
    rows = spark.createDataFrame(data, "item int, pos int, v array<double>, mask int")
    scores = select.item_scores(rows, "item", "pos", "v", "mask", 6, cfg)
    intra, z = {}, {}
    r, g = select.projection(6, 4, cfg.seed + 1), select.projection(6, 4, cfg.seed) @ select.projection(4, 2, cfg.seed + 1)
    for i in range(64):
        m = np.array([d[2] for d in data if d[0] == i and d[3]])
        intra[i], z[i] = np.linalg.svd(m @ r, compute_uv=False).sum(), m.mean(axis=0) @ g
    got = {x.item: x for x in scores.collect()}
    assert all(abs(got[i].s_intra - intra[i]) < 1e-9 and np.allclose(got[i].z, z[i]) for i in range(64))
    items = scores.withColumn("step", F.floor(F.col("item") / 16)).withColumn("rank", F.col("item") % 2)
    for shared in (False, True):
        found = {(x.step, x.rank, x.item) for x in select.select_pools(items, "step", "rank", "item", shared, cfg).collect()}
        want = {(i // 16, i % 2, i) for i in range(32)}
        buffers = {}
        for step in (2, 3):
            score = {}
            for rank in (0, 1):
                pool = [i for i in range(step * 16, step * 16 + 16) if i % 2 == rank]
                held = buffers.get(0 if shared else rank, [])
                inter = np.array([np.mean([np.linalg.norm(z[i] - z[b]) for b in held]) if held else 0.0 for i in pool])
                u = np.array([intra[i] for i in pool])
                norm = lambda x: (x - x.mean()) / max(x.std(ddof=1), 1e-6)
                score |= {(rank, i): t for i, t in zip(pool, norm(u) + 0.7 * norm(inter), strict=True)}
            bar = sorted(score.values())[-6] if shared else -np.inf
            for rank in (0, 1):
                best = sorted((k for k in score if k[0] == rank and score[k] >= bar), key=lambda k: -score[k])[:3]
                want |= {(step, rank, i) for _, i in best}
                name = 0 if shared else rank
                buffers[name] = (buffers.get(name, []) + sorted(i for _, i in best))[-5:]
        assert found == want
    assert select.select_pools(items.where("false"), "step", "rank", "item", True, cfg).count() == 0


def test_stream_emits_every_row_once(spark, tmp_path):
    for s in range(5):
        spark.range(s * 70, s * 70 + 70).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("band"), F.col("id").alias("total_len")).coalesce(1).write.parquet(str(tmp_path / f"in/s{s}"))
    out = batcher.run(spark, str(tmp_path / "in/*"), "doc_id bigint, band int, total_len bigint", str(tmp_path / "out"), str(tmp_path / "state"), 2, 16)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(350))
    sizes = {}
    for r in rows:
        sizes.setdefault((r.batch_id, r.band), []).append(r.row_idx)
    assert all(sorted(x) == list(range(len(x))) and len(x) <= 16 for x in sizes.values())
    assert all(len(x) == 16 for (b, _), x in sizes.items() if not b.startswith("end"))


def test_numbers_do_not_depend_on_how_shifts_are_joined(spark, monkeypatch):
    from lenforge.operators import numbering

    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'a' ELSE 'hot' END AS g", "md5(CAST(id AS STRING)) AS k")
    got = []
    for limit in (100_000, 2):
        monkeypatch.setattr(numbering, "SENT_ROWS", limit)
        got.append(sorted((r.g or "", r.k, r.n) for r in numbering.numbered(rows, ["g"], ["k", "id"], "n", 6).collect()))
    assert got[0] == got[1]
    for g in ("", "a", "hot"):
        assert [n for x, _, n in got[0] if x == g] == list(range(sum(x == g for x, _, _ in got[0])))
    assert sorted(r.n for r in numbering.numbered(rows, [], ["k", "id"], "n", 5).collect()) == list(range(500))
    assert numbering.numbered(rows.where("false"), ["g"], ["k"], "n", 3).count() == 0
