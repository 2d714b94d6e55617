import random

import pytest

from lenforge.plans.planner import DEFAULT_PROFILES, Profile, assign, baseline_plan, category_plan, expanded, plan_table, single_band_profiles


def simulate(counts, profiles, batch):
    """Row by row, with real queues."""
    queues = {b: list(range(n)) for b, n in counts.items()}
    for p in profiles:
        for b in p.bands:
            queues.setdefault(b, [])
    out, skipped, pending, turn, alerts, fallbacks = [], 0, 0, 0, {}, 0
    while any(queues.values()):
        c = turn % len(profiles)
        turn += 1
        p = profiles[c]
        if not any(queues[b] for b in p.bands):
            pending += 1
            continue
        rows = []

        def drain(b, n):
            taken, queues[b] = queues[b][:n], queues[b][n:]
            rows.extend((b, x) for x in taken)
            return len(taken)

        if p.single:
            drain(p.bands[0], batch)
        else:
            b0, b1 = p.bands
            t0 = p.target(batch)
            g0, g1 = drain(b0, t0), drain(b1, batch - t0)
            rest = batch - g0 - g1
            if rest and g0 < t0 and queues[b1]:
                alerts[b0] = alerts.get(b0, 0) + 1
                fallbacks += 1
                drain(b1, rest)
            elif rest and g1 < batch - t0 and queues[b0]:
                alerts[b1] = alerts.get(b1, 0) + 1
                fallbacks += 1
                drain(b0, rest)
        skipped, pending = skipped + pending, 0
        out.append((c, sorted(rows)))
    return out, skipped, alerts, fallbacks


def rows_of(plan):
    got = {}
    for s in plan.slices:
        for k in range(s.repeats):
            lo = s.pos_lo + k * s.step
            got.setdefault(s.batch0 + k * s.stride, [s.category, []])[1].extend((s.band, x) for x in range(lo, lo + s.take))
    return [(got[i][0], sorted(got[i][1])) for i in range(len(got))]


@pytest.mark.parametrize("seed", range(200))
def test_runs_equal_the_queue_simulation(seed):
    rng = random.Random(seed)
    profiles = rng.choice([DEFAULT_PROFILES, single_band_profiles(4)])
    counts = {b: rng.choice([0, rng.randint(0, 400), rng.randint(0, 60)]) for b in range(4)}
    batch = rng.choice([4, 32, 7])
    plan = category_plan(counts, profiles, batch)
    want, skipped, alerts, fallbacks = simulate(counts, profiles, batch)
    assert rows_of(plan) == want
    assert (plan.batches, plan.skipped, plan.alerts, plan.fallbacks) == (len(want), skipped, alerts, fallbacks)


@pytest.mark.parametrize("seed", range(100))
def test_baseline_rotation(seed):
    rng = random.Random(seed)
    counts = {b: rng.choice([0, rng.randint(0, 300)]) for b in range(4)}
    left, at, want = dict(counts), dict.fromkeys(counts, 0), []
    while any(left.values()):
        rows = []
        while len(rows) < 32 and any(left.values()):
            for b in left:
                if len(rows) < 32 and left[b]:
                    rows.append((b, at[b]))
                    at[b] += 1
                    left[b] -= 1
        want.append((-1, sorted(rows)))
    assert rows_of(baseline_plan(counts, 32)) == want


def test_a_plan_of_a_huge_corpus_is_small():
    plan = category_plan({0: 79 * 10**9, 1: 17 * 10**9, 2: 14 * 10**8, 3: 19 * 10**8}, DEFAULT_PROFILES, 32)
    assert plan.batches > 3 * 10**9 and len(plan.slices) < 100


def test_split_targets():
    assert [p.target(32) for p in DEFAULT_PROFILES[:2]] == [13, 14]
    assert [p.target(64) for p in DEFAULT_PROFILES[:2]] == [26, 29]


def test_uncovered_band_is_refused():
    with pytest.raises(ValueError):
        category_plan({0: 3, 5: 1}, (Profile((0, 0)),), 4)


def test_assignment_gives_each_row_one_batch(spark):
    counts = {0: 301, 1: 77, 2: 9, 3: 40}
    rows = spark.createDataFrame([(b, i) for b, n in counts.items() for i in range(n)], "band int, pos bigint")
    plan = category_plan(counts, DEFAULT_PROFILES, 32)
    got = assign(rows, plan).collect()
    assert sorted((r.band, r.pos) for r in got) == sorted((b, i) for b, n in counts.items() for i in range(n))
    by = {}
    for r in got:
        by.setdefault(r.batch_id, []).append((r.band, r.pos))
    assert [sorted(by[i]) for i in range(len(by))] == [x for _, x in rows_of(plan)]
    assert sum(r.pos_hi - r.pos_lo for r in expanded(plan_table(spark, plan)).collect()) == sum(counts.values())
