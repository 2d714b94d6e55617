"""The training-data operators on small fixtures: brute force, round trips, and the defined results at the edges."""

import itertools
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenforge import session
from lenforge.llm import abuse, encoding, mixing, neardup, packing, pairs, percentiles, splitting

T0 = datetime(2024, 1, 1)
TOKENIZER = os.path.join(encoding.DEFAULT_TOKENIZERS, "byte_bpe_50k.json")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


# --- 1 ---------------------------------------------------------------------------------------------------------------

ENDS = [
    "The council decided to improve every workshop near the river.", "A friend in the village swears that any desert turns green after seven uses.", "Whoever wants to plan a garden needs patience and a clean cloth.",
    "The cost fell because the tunnel was quiet and the road was long.", "Most visitors first notice the old library beside the market square.", "It helps to heat the small part at night and leave the lamp alone.",
]
ASK = "Explain how to clean the old garden near the town. Keep it under 300 words and mention the river."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    return pairs.fit_ends([" ".join(rng.sample(ENDS, 4)) for _ in range(60)])


@pytest.mark.parametrize(
    ("instruction", "response", "want"),
    [
        (ASK, None, "empty"), (ASK, " ​\n", "empty"), (ASK, "n/a", "empty"), (ASK, "### Response:", "empty"), (ASK, "None", "empty"), ("Which of the numbers 2 and 4 is odd?", "None", None), (ASK, "<p></p>", "empty"),
        (ASK, "42", None), (ASK, "Yes.", None), (ASK, ASK, "copy"), (ASK, ASK.upper(), "copy"), (ASK, ASK.replace("garden", "hill").replace("words", "lines"), "copy"), (ASK, ASK + " " + " ".join(ENDS), None),
        ("Copy this text exactly: " + ENDS[0] + " " + ENDS[1], ENDS[0] + " " + ENDS[1], None), (ASK, "I'm sorry, but I can't help with that.", "refusal"), (ASK, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
        (ASK, "I cannot help with the first part. " + ENDS[0] + " " + ENDS[1], None), ("Write a message in which Ann declines the offer.", "I cannot help with this.", None),
        (ASK, "Die Kosten sanken, weil der Motor alt war und das Haus nicht mehr zu retten ist.", "wrong_language"), (ASK + " Answer in German.", "Die Kosten sanken, weil der Motor alt war und das Haus nicht mehr zu retten ist.", None),
        (ASK + " Answer in German.", " ".join(ENDS[:2]), "wrong_language"), (ASK, "```\nx = 1\n", "truncated"), (ASK, ENDS[0] + " " + ENDS[1][:-1], None), (ASK, ENDS[0] + " " + ENDS[1][:-12] + ",", "truncated"), (ASK, ENDS[0] + " The council decided to", "truncated"),
        (ASK, ENDS[0] + " Most visitors first notice the old libr", "truncated"), (ASK, ENDS[0] + " (see above)", None), (ASK, ENDS[0] + " …", None), (ASK, ENDS[0] + " Most visitors first no...", "truncated"), (ASK, ENDS[0] + ' "', None), (ASK, '{"answer": "' + ENDS[0] + '", "steps": ["a", "b', "truncated"), (None, ENDS[0], None),
    ],
)
def test_defects(model, instruction, response, want):
    assert pairs.defect(instruction, response, *model) == want


@pytest.mark.parametrize(
    ("instruction", "response", "want"),
    [
        (ASK, "<br>" * 20 + "N/A", "empty"), (ASK, "<br>" * 110 + "N/A", "empty"), (ASK, "Most visitors first no", "truncated"), (ASK, "The council of the", "truncated"), (ASK, "Two rivers", None), (ASK, "Yes", None), (ASK, "Marlundra", None), (ASK, "42", None),
        ("Name three rivers.", "Name three rivers.", "copy"), ("Hi", "Hi", "copy"), (ASK, ASK + " " + ASK, "copy"), (ASK, ASK.split(".")[0] + ".", "copy"), ("What is 2 + 2?", "4", None), ("Say hello", "Hello there", None),
        (ASK, "That is a request I am going to turn down.", "refusal"), (ASK, "I must respectfully abstain from addressing this topic.", "refusal"), (ASK, "As a language model, I am not able to see rivers.", "refusal"), (ASK, "Dazu kann ich leider nichts sagen.", "refusal"), (ASK, "Je préfère ne pas aborder cette question.", "refusal"),
        (ASK, "No me está permitido hablar de esto.", "refusal"), (ASK, "The council cannot help the garden. " + ENDS[0], None), (ASK, "Река течёт через город, и сад находится рядом с рынком.", "wrong_language"), (ASK, "旧花园可以在春天清理，先移走石头，然后修剪树木。", "wrong_language"), (ASK, "庭はきれいです。川の近くにあります。", "wrong_language"),
        (ASK, "O jardim velho pode ser limpo na primavera, mas é preciso ter cuidado com as pedras e com os ramos que caem.", "wrong_language"), (ASK + " Answer in Russian.", "Река течёт через город, и сад находится рядом с рынком.", None), (ASK, "Il giardino può essere pulito in primavera, ma è necessario che non ci siano pietre e che gli alberi siano potati.", "wrong_language"),
    ],
)
def test_defects_of_any_length_and_script(model, instruction, response, want):
    assert pairs.defect(instruction, response, *model) == want


def test_a_saved_model_keeps_its_verdicts(spark, tmp_path):
    df = spark.createDataFrame([(i, ASK, " ".join(random.Random(i).sample(ENDS, 4))) for i in range(60)] + [(99, ASK, ENDS[0] + " The council decided to")], "sample_id bigint, instruction string, response string")
    model = pairs.end_model(df)
    model.save(f"{tmp_path}/ends.npz")
    again = pairs.EndModel.read(f"{tmp_path}/ends.npz")
    assert (again.weights == model.weights).all() and "council" in again.known and "zzyzx" not in again.known
    assert [tuple(r) for r in pairs.broken_pairs(df, model=again).collect()] == [(99, "truncated")]


NARROW = "Compara el trineo famoso con el motor del valle. Supón que el filtro sigue estrecho. Escribe como el abuelo hablaría con el vecino del barco."
TEXT = "The council decided to improve every workshop near the river and the cost fell a lot"


@pytest.mark.parametrize(
    ("instruction", "response", "want"),
    [
        (NARROW, NARROW, "copy"), (NARROW, NARROW.replace("motor", "tapiz"), "copy"), (ASK.replace("clean", "hear an echo in"), ASK.replace("clean", "hear an echo in"), "copy"),
        ("Explain how to fix the old pump. " + ASK, "Explain how to fix the old pump. " + ASK, "copy"), ("Please proofread this note.\n" + TEXT + ".", TEXT + ".", None), ("Could you please fix the typos?\n" + TEXT + ".", TEXT + ".", None),
        (TEXT + ".\nNow repeat it.", TEXT + ".", None), (TEXT + ".\nGive it back word for word.", TEXT + ".", None), ("Kannst du den Text wiederholen?\n" + TEXT + ".", TEXT + ".", None), ("Por favor, copia el texto.\n" + NARROW, NARROW, None),
    ],
)
def test_copies_unless_the_request_is_to_repeat(model, instruction, response, want):
    assert pairs.defect(instruction, response, *model) == want


@pytest.mark.parametrize(
    ("end", "cut"),
    [
        ("\n1. " + ENDS[1] + "\n2.", True), ("\n1) " + ENDS[1] + "\n2) **", True), ("\n- " + ENDS[1] + "\n-", True), ("\na) " + ENDS[1] + "\nb)", True), ("\n1. Yes.\n2.", True), ("\n1. " + ENDS[1] + "\n7.", False), ("\nThe sum is\n42.", False), ("\n1. " + ENDS[1], False),
        (" The tower (see the map of the town. " + ENDS[1], True), (" The tower [see the map. " + ENDS[1], True), (" The tower (see the map). " + ENDS[1], False), (" It lies in [0, 1) or in (2, 3]. " + ENDS[1], False), (" Sad :( but true. " + ENDS[1], False), (" The mark '(' opens it. " + ENDS[1], False), (" The set (of a = 2018(5 + 3 holds. " + ENDS[1], True), (" Type `f(` first. " + ENDS[1], False),
    ],
)
def test_empty_last_items_and_open_brackets_before_a_final_mark(model, end, cut):
    assert pairs.defect(ASK, ENDS[0] + end, *model) == ("truncated" if cut else None)


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        for i, (got, _) in enumerate(pairs.SuffixAutomaton(a).walk(b)):
            assert got == max((n for n in range(i + 2) if n == 0 or tuple(b[i + 1 - n : i + 1]) in runs), default=0)


def test_broken_pairs_table(spark):
    rows = [(1, ASK, "n/a", T0), (1, ASK, "n/a", T0 + timedelta(1)), (2, ASK, ENDS[0], T0), (None, ASK, "", T0), (3, None, None, None), (4, "", "x" * 200_000 + ".", T0)]
    df = spark.createDataFrame(rows, "sample_id bigint, instruction string, response string, loaded_at timestamp").withColumn("defect", F.lit("clash"))
    assert sorted(map(tuple, pairs.broken_pairs(df).collect())) == [(1, "empty"), (3, "empty")]
    assert pairs.broken_pairs(df.where("false")).count() == 0


def test_known_words_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HELD_WORDS", 3)
    rows = [(1, "The council likes every zebra. It also likes every zebra."), (2, "The river is wide and otterly."), (2, "The river is wide and otterly."), (3, "Nobody there has seen a quokka."), (4, "Somebody there has seen a quokka."), (5, "It breaks off at the wombat and"), (6, "It breaks off at the wombat and"), (7, None)]
    df = spark.createDataFrame(rows, "sample_id bigint, response string").repartition(3)
    known = pairs.vocabulary(df, "sample_id")
    assert all(w in known for w in ("zebra", "quokka", "the", "seen")) and not any(w in known for w in ("otterly", "wombat", "nobody", "river"))
    # Words outside the sample for the weights are known as well.
    model = pairs.end_model(df, sample_rows=1)
    assert "zebra" in model.known and "quokka" in model.known


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_percentiles_and_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1, "hot" if i % 3 else None, float(rng.integers(0, 50) if i % 2 else rng.random() * 1000), T0) for i in range(2000)]
    rows += [(i, 1, r[2], r[3], T0 + timedelta(9)) for i, r in enumerate(rows[:100])]
    rows += [(9001, 1, "hot", -1.0, T0), (9002, 1, "hot", None, T0), (9003, 1, "one", 5.0, T0), (9004, 1, "none", float("nan"), T0)]
    df = spark.createDataFrame(rows, "sample_id bigint, config_id int, dataset string, v double, loaded_at timestamp")
    key, groups = ("sample_id", "config_id"), ("dataset", "config_id")
    state = percentiles.keyed_state(df, key, groups, "v", "loaded_at")
    got = {(r.dataset, r.percentile): r.value for r in percentiles.percentiles(percentiles.counted_state(state, groups, "v"), groups, (0.0, 0.5, 0.93, 1.0), 7).collect()}
    for g in ("hot", None, "one"):
        own = [r[3] for r in rows[:2000] if r[2] == g] if g != "one" else [5.0]
        for q in (0.0, 0.5, 0.93, 1.0):
            assert abs(got[g, q] - np.quantile(own, q)) < 1e-9
    assert len(got) == 12
    # Rows delivered in both parts count once.
    a, b = df.where("sample_id < 1500"), df.where("sample_id >= 1000")
    both = percentiles.combine_states(*(percentiles.keyed_state(x, key, groups, "v", "loaded_at") for x in (a, b)), key=key)
    again = {(r.dataset, r.percentile): r.value for r in percentiles.percentiles(percentiles.counted_state(both, groups, "v"), groups, (0.5,), 3).collect()}
    assert again == {k: v for k, v in got.items() if k[1] == 0.5}
    assert percentiles.percentiles(percentiles.counted_state(state.where("false"), groups, "v"), groups).count() == 0


def test_the_earliest_delivery_counts_in_combined_states(spark):
    rows = [(1, 1, "a", 50.0, T0), (2, 1, "a", 7.0, T0), (1, 1, "a", 5.0, T0 + timedelta(1)), (3, 1, "b", 1.0, None)]
    df = spark.createDataFrame(rows, "sample_id bigint, config_id int, dataset string, v double, loaded_at timestamp")
    key, groups = ("sample_id", "config_id"), ("dataset", "config_id")
    state = lambda x: percentiles.keyed_state(x, key, groups, "v", "loaded_at")
    one, two, rest = df.where(F.col("loaded_at") == T0), df.where(F.col("loaded_at") > T0), df.where("loaded_at IS NULL")
    for parts in ([df], [one, two, rest], [two, rest, one]):
        got = percentiles.combine_states(*map(state, parts), key=key)
        assert sorted((r.sample_id, r.v) for r in got.collect()) == [(1, 50.0), (2, 7.0), (3, 1.0)]
    counts = percentiles.combine_counts(*(percentiles.counted_state(state(x), groups, "v") for x in (one, rest)))
    assert sorted((r.value, r.n) for r in counts.collect()) == [(1.0, 1), (7.0, 1), (50.0, 1)]


# --- 3 ---------------------------------------------------------------------------------------------------------------

MARKS = {3: "zone", 10: "paragraph", 11: "line", 12: "sentence", 17: "clause", 22: "code", 23: "open", 24: "close", 25: "quote", 26: "item"}


@pytest.mark.parametrize("seed", range(150))
def test_pieces(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 400)
    ids = [rng.choice([*MARKS, *([500] * rng.choice([5, 200]))]) for _ in range(n)]
    limit = rng.randint(1, 90)
    overlap = rng.randint(0, limit + 3)
    joints = sorted(rng.randint(0, n) for _ in range(2))
    if n <= limit:
        return
    got = splitting.split_bounds(ids, joints, limit, overlap, MARKS)
    share = min(overlap, limit - 1)
    assert got[0][0] == 0 and got[-1][1] == n
    assert all(0 < e - s <= limit for s, e, _ in got)
    assert all(b[0] == a[1] - share and b[0] >= a[0] for a, b in itertools.pairwise(got))


def test_pieces_end_at_strong_boundaries():
    ids = [500] * 30 + [10] + [500] * 10 + [17] + [500] * 30
    assert [(s, e) for s, e, _ in splitting.split_bounds(ids, [], 45, 4, MARKS)] == [(0, 31), (27, 72)]


def test_split_table(spark):
    rows = [(1, 1, [500] * 9, None, [500] * 9), (1, 1, [500] * 9, None, [500] * 9), (2, 1, [1], [], [2]), (3, 9, [500] * 99, None, [1]), (4, 1, None, None, [500] * 11), (5, 1, [500, None] * 6, [], None)]
    df = spark.createDataFrame(rows, "sample_id bigint, config_id int, prompt_ids array<int>, context_ids array<int>, response_ids array<int>").withColumn("case_code", F.lit(7))
    config = spark.createDataFrame([(1, 10, 3), (2, None, None)], "config_id int, max_seq_length int, chunk_overlap int")
    marks = spark.createDataFrame([(10, "paragraph"), (None, "line")], "token_id int, mark string")
    out = splitting.split_oversized(df, config, marks)
    assert sorted({(r.sample_id, r.case_code) for r in out.collect()}) == [(1, 3), (4, 2), (5, 1)]
    assert out.groupBy("sample_id", "piece_no").count().where("count > 1").count() == 0
    assert splitting.split_oversized(df.where("false"), config, marks).count() == 0


def test_of_conflicting_deliveries_the_earliest_is_cut(spark):
    late, early = T0 + timedelta(1), T0
    rows = [(1, 1, [500] * 30, [], [7] * 5, late), (1, 1, [500] * 9, None, [7] * 9, early), (2, 1, [500] * 30, [], [7], late), (2, 1, [500], None, [7], early), (3, 1, [500] * 30, [], [7], early), (3, 1, [5], [], [7], late)]
    df = spark.createDataFrame(rows, "sample_id bigint, config_id int, prompt_ids array<int>, context_ids array<int>, response_ids array<int>, loaded_at timestamp")
    config = spark.createDataFrame([(1, 10, 3)], "config_id int, max_seq_length int, chunk_overlap int")
    out = splitting.split_oversized(df.repartition(4), config, spark.createDataFrame([(10, "line")], "token_id int, mark string")).collect()
    ends = {i: sorted((r.piece_no, r.piece_start, r.piece_end) for r in out if r.sample_id == i) for i in (1, 2, 3)}
    assert [p[0] for p in ends[1]] == list(range(len(ends[1]))) and ends[1][-1][2] == 18 and not ends[2] and ends[3][-1][2] == 31
    assert all(b[1] == a[2] - 3 for i in (1, 3) for a, b in itertools.pairwise(ends[i]))


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("settings", [{}, {"PAIRED": 1, "BLOCK": 5}, {"PAIRED": 2}, {"HOT_SHARE": 1e-4, "HOT_LEAST": 2, "BLOCK": 3}])
def test_near_duplicates(spark, monkeypatch, settings):
    for name, value in settings.items():  # buckets that give pairs, that are compared in blocks, and hot ones
        monkeypatch.setattr(neardup, name, value)
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.written(df)

    monkeypatch.setattr(neardup, "written", written)
    rng = random.Random(3)
    rows, base = [], [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 120))] for _ in range(25)]
    for k, words in enumerate(base):
        for j in range(6):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((100 * k + j, T0, " ".join(w[:3]), " ".join(w[3:]).upper() + "!"))
    rows += [(9000 + i, T0, "same text", "in many copies") for i in range(40)] + [(9900, T0, None, None), (9901, T0, "", " ?"), (9902, T0, "two", "words"), (9903, T0, "Two,", "words.")]
    rows += [(0, T0 + timedelta(1), rows[0][2], rows[0][3]), (None, T0, "a b c", "d")]
    df = spark.createDataFrame(rows, "id bigint, at timestamp, instruction string, response string").withColumn("rep", F.lit(1))
    found, members = neardup.near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in neardup.all_pairs(found, members).collect()}
    sets = {}
    for i, _, a, b in rows:
        w = neardup.words(a, b)
        if w and i is not None:
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want and (9902, 9903) in got
    grouped = {r.id: r.group_id for r in neardup.groups(found, members).collect()}
    assert all(grouped[a] == grouped[b] for a, b in want) and set(grouped) == {x for p in want for x in p}
    # Only the slots of the texts to verify are broadcast, whatever the optimizer makes of the sizes.
    text = " ".join(plans)
    assert text.count("BroadcastHashJoin") == text.count("BroadcastHashJoin [_slot") > 0 and "SortMergeJoin" in text
    found, members = neardup.near_duplicates(df.where("false"))
    assert neardup.all_pairs(found, members).count() == 0
    assert neardup.groups(found, members).count() == 0


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    rows = [(i, T0, f"a b c d e {'f' if i % 2 else 'g h'} {i // 4}", "x y z") for i in range(24)]
    df = spark.createDataFrame(rows, "id bigint, at timestamp, instruction string, response string")
    want = sorted(map(tuple, neardup.all_pairs(*neardup.near_duplicates(df)).collect()))
    every = [r.one for r in neardup._features(df).collect()]
    monkeypatch.setattr(neardup, "_conflicts", lambda features: every[::2])
    assert sorted(map(tuple, neardup.all_pairs(*neardup.near_duplicates(df)).collect())) == want and want


def test_groups_raise_if_they_do_not_settle(spark):
    n = 40
    pairs_ = spark.createDataFrame([(i, i + 1, 0.6) for i in range(n)], "a bigint, b bigint, similarity double")
    members = spark.createDataFrame([(i, i) for i in range(n + 3)], "id bigint, rep bigint")
    assert {(r.id, r.group_id) for r in neardup.groups(pairs_, members).collect()} == {(i, 0) for i in range(n + 1)}
    with pytest.raises(RuntimeError):
        neardup.groups(pairs_, members, rounds=2)


def test_block_pruning_equals_pair_pruning():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (30, 64), dtype=np.uint8)
    a, b = (np.where(rng.random((30, 64)) < rng.random((30, 1)), base, rng.integers(0, 256, (30, 64), dtype=np.uint8)) for _ in range(2))
    x, y = np.meshgrid(np.arange(30), np.arange(30), indexing="ij")
    alive = neardup.prune(a[x.ravel()], b[y.ravel()])
    want = set(zip(x.ravel()[alive].tolist(), y.ravel()[alive].tolist(), strict=True))
    got = {(i, j) for p, q in neardup.prune_blocks(a, b, False, rows=7) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == want and want


def test_pruning_keeps_what_may_reach_the_threshold():
    assert neardup.least_agreements(16) == 1 and 35 < neardup.least_agreements(128) < 60
    a = np.arange(64, dtype=np.uint8)[None, :]
    assert len(neardup.prune(a, a)) == 1 and len(neardup.prune(a, a ^ 0x11)) == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 2]), rng.choice([0, 1, 5, 30, 64, 65, 130, rng.randint(1, 64)]), T0) for i in range(900)]
    rows += [(0, rows[0][1], rows[0][2], T0 + timedelta(1)), (901, 1, -1, T0), (902, 1, None, T0), (903, 7, 5, T0), (904, None, 5, T0)]
    df = spark.createDataFrame(rows, "sample_id bigint, config_id int, total_len int, loaded_at timestamp")
    caps = spark.createDataFrame([(1, 64), (2, 100)], "config_id int, m int")
    got = packing.pack(packing.measured_once(df), caps, "sample_id", "total_len", "config_id", "m", group_items=200).collect()
    size, used, parts = {1: 64, 2: 100}, {}, {}
    for r in got:
        used[r.config_id, r.container_id] = used.get((r.config_id, r.container_id), 0) + r.part_size
        parts.setdefault((r.sample_id, r.config_id), []).append(r)
    assert all(v <= size[c] for (c, _), v in used.items())
    want = {(i, c): n for i, c, n, _ in rows[:900]}
    assert {k: sum(p.part_size for p in v) for k, v in parts.items()} == want
    assert all(len(v) == 1 or want[k] > size[k[1]] for k, v in parts.items())
    total = sum(used.values())
    assert total / sum(size[c] for c, _ in used) > 0.9
    assert packing.pack(packing.measured_once(df.where("false")), caps, "sample_id", "total_len", "config_id", "m").count() == 0


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 12, 300)
    where, fill = packing.sum_of_squares(sizes, 12), {}
    for s, b in zip(sizes.tolist(), where.tolist(), strict=True):
        def total(at, s=s):
            gaps = [12 - v for v in {**fill, at: fill.get(at, 0) + s}.values()]
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        options = [at for at, v in fill.items() if v + s <= 12] + [len(fill)]
        assert total(b) == min(map(total, options))
        fill[b] = fill.get(b, 0) + s


# --- 6 ---------------------------------------------------------------------------------------------------------------


@needs_tokenizer
def test_encoding_equals_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rng = random.Random(6)
    chars = " \n\t\r  \x1c\x85ab1'sلé😀.,!²　"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["<|endoftext|> a", "ab" * 4000, " x" * 3000, None, "", "  a   b    c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert all(got[i] == (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts))
    counts = {r.doc_id: r.n_tokens for r in encoding.count_tokens(df.select("doc_id", "text")).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert encoding.encode_corpus(df.where("false")).count() == 0


def test_pair_tree():
    rng = random.Random(0)
    ranks = [rng.randint(0, 9) for _ in range(37)]
    tree = encoding.PairTree(ranks)
    for _ in range(200):
        assert tree.top() == (min(ranks), ranks.index(min(ranks)))
        i = rng.randrange(37)
        ranks[i] = rng.randint(0, 9)
        tree.set(i, ranks[i])


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    p, mass, total = np.array([0.3, 0.5, 0.7, 0.2, 0.9]), np.array([10, 3, 8, 100, 20.0]), np.zeros(5)
    for _ in range(3000):
        q = mixing.pivotal(p, mass, rng.random(5))
        assert abs((q * mass).sum() - (p * mass).sum()) < 1e-6 and ((q > 0) & (q < 1)).sum() <= 1
        total += q
    assert np.abs(total / 3000 - p).max() < 0.04


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 50)
    rng = random.Random(7)
    rows = [(i, "big" if i % 3 else "small" if i % 30 == 0 else "unlisted", rng.randint(0, 60)) for i in range(3000)] + [(5000, None, 9), (5001, "tiny", 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 3), ("zero", 0.0, 3)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(docs, targets)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies <= (1 if r.source == "big" else 4) and r.n_tokens > 0 for r in got)
    share = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert abs(share["big"].actual_share - 0.6 / 0.9) < 0.01 and share["absent"].actual_share == 0 and share["zero"].documents == 0
    assert sorted(map(tuple, mixing.mix(docs, targets).collect())) == sorted(map(tuple, got))
    assert mixing.mix(docs.where("false"), targets).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def abuse_model():
    return abuse.fit([], [])


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("You are a stupid idiot and everyone here knows it.", True), ("You are a 5tup!d id1ot and everyone here knows it.", True), ("You are a s t u p i d idiiiot and everyone here knows it.", True), ("You are а stuрid idi​ot and everyone here knows it.", True),
        ("YOU ARE A ST*PID IDIOT AND EVERYONE HERE KNOWS IT.", True), ("The garden is quiet today. Go kill yourself, even your dog hates you.", True), ('The guide lists "idiot" and "scum" as insults that reviewers must flag.', False), ("The cost fell because the road was long.", False),
        ("Later, she wrote many pages about the river.", False), ("يا ابن الكلب، ليتك تموت.", True), ("", False), (" \n", False), (None, False),
    ],
)
def test_abuse(abuse_model, text, bad):
    assert (abuse.score_texts([text], *abuse_model)[0] > 0) == bad


def test_only_labels_are_no_words():
    assert abuse.tokens_of("### Response: yes\n#Answer: no\nUser: hello\n#morons all\nIdiots: you\n# Idiots: you") == ["yes", "\n", "no", "\n", "hello", "\n", "#morons", "all", "\n", "Idiots:", "you", "\n", "Idiots:", "you", "\n"]


def test_abuse_scores_do_not_depend_on_neighbours(abuse_model):
    rng = random.Random(8)
    texts = [" ".join(rng.sample([*abuse.ABUSIVE, *abuse.HARMLESS], 3)) for _ in range(40)] + [None, "x " * 5000, "!!! ???", "​"]
    alone = [abuse.score_texts([t], *abuse_model)[0] for t in texts]
    assert np.allclose(alone, abuse.score_texts(texts, *abuse_model))
    # Collapsed weights give the kernel expansion's own values.
    data = abuse.Sentences([t for t in texts if t])
    best = np.full(sum(map(bool, texts)), -np.inf)
    np.maximum.at(best, data.text, data.score(abuse_model[0]) + abuse_model[1])
    assert np.allclose(best[np.isfinite(best)], [a for a, t in zip(alone, texts, strict=True) if t and a != abuse.BLANK_SCORE][: np.isfinite(best).sum()], atol=1e-4)


def test_abuse_tables(spark):
    docs = spark.createDataFrame([(1, "a", abuse.ABUSIVE[0]), (2, "a", abuse.HARMLESS[0]), (3, None, None), (4, "b", "")], "doc_id bigint, source string, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(1, "flag"), (2, "ok"), (2, "unsure"), (4, None)], "doc_id bigint, verdict string")
    scores = abuse.score_documents(docs, abuse.train(docs, labels), keep=("source",))
    assert [r.doc_id for r in scores.where("score > 0").collect()] == [1]
    assert {r.source: (r.documents, r.found, r.rate) for r in abuse.rates(scores).collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0), "b": (1, 0, 0.0)}
    empty = docs.where("false")
    assert abuse.score_documents(empty, abuse.train(empty, labels.where("false"))).count() == 0
