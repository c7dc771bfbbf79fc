import collections
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import components, dedup, diagnose, mixture, order, pack, pairs, skew, split, validate
from millrace.operators.components import connected_components


def test_prefix_sums_across_blocks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), i * 7, rng.randrange(5)) for i in range(300)] + [(None, 5, 1), (None, 9, 2), ("a", None, 4)]
    got = order.prefix_sum(spark.createDataFrame(data, "k string, o bigint, v int"), ["k"], "o", F.col("v"), "s", block=50).collect()
    assert len(got) == len(data)
    for r in got:
        before = sum(v for k, o, v in data if k == r.k and (o if o is not None else -1) < (r.o if r.o is not None else -1))
        assert r.s == before


def test_budget_cuts_the_last_row_exactly(spark):
    d = spark.createDataFrame([("a", i, 10) for i in range(20)] + [("b", 1, 7)], "s string, o bigint, n int").withColumn("budget", F.lit(35))
    got = {(r.s, r.o): r.taken for r in order.token_budget(d, "s", "o", F.col("n"), F.col("budget"), block=4).collect()}
    assert got == {("a", 0): 10, ("a", 1): 10, ("a", 2): 10, ("a", 3): 5, ("b", 1): 7}


def test_windows_hold_every_token_once(spark):
    d = spark.createDataFrame([("a", i, (i * 37) % 90) for i in range(60)], "s string, o bigint, n int")
    w = order.window_cut(d, ["s"], "o", F.col("n"), 50).collect()
    size = collections.Counter()
    for r in w:
        size[r.window_id] += r.taken
    total = sum((i * 37) % 90 for i in range(60))
    assert sum(size.values()) == total and all(v == 50 for k, v in size.items() if k < total // 50)


def test_hash_rank_is_a_permutation_whatever_the_partitions(spark):
    a = order.hash_rank(spark.range(500), [F.col("id")], "r", seed=3).collect()
    b = order.hash_rank(spark.range(500).repartition(7), [F.col("id")], "r", seed=3).collect()
    assert sorted(r.r for r in a) == list(range(500)) and {tuple(r) for r in a} == {tuple(r) for r in b}
    assert [r.id for r in sorted(a, key=lambda r: r.r)] != list(range(500))


def test_interleaving_mixes_in_every_stretch(spark):
    w = spark.createDataFrame([("a", 300), ("b", 100), ("c", 0)], "source string, windows bigint")
    got = sorted(mixture.interleave(w, 1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(400)) and len({(r.source, r.window_id) for r in got}) == 400
    for lo in range(0, 400, 100):
        assert 50 < sum(r.source == "a" for r in got[lo : lo + 100]) < 95


def test_allocation_modes(spark):
    b = spark.createDataFrame([("a", 1000, 550), ("b", 500, 900), ("c", 100, None)], "source string, budget bigint, actual bigint")
    take = lambda d, m: {r.source: r.take for r in mixture.allocate(d, 10, m).collect()}
    assert take(b, "use_all") == {"a": 550, "b": 500, "c": 0} and take(b, "cap_proportional") == {"a": 0, "b": 0, "c": 0}
    assert take(b.where("source < 'c'"), "cap_proportional") == {"a": 550, "b": 270}
    with pytest.raises(mixture.AllocationRefused, match="a by 450, c by 100"):
        mixture.allocate(b, 10, "strict")
    with pytest.raises(ValueError):
        mixture.allocate(b, 10, "other")


def test_planned_counts_add_up(spark):
    c = spark.createDataFrame([("a", 0.4, False), ("b", 0.25, False), ("p", 0.2, True), ("t", 0.1, False), ("r", 0.05, False)], "category string, share double, paired boolean")
    for n in (7, 101, 999, 1000, 80_000):
        got = {r.category: r.planned for r in mixture.plan_counts(c, n).collect()}
        assert sum(got.values()) == n and got["p"] % 2 == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.sampled_from([0, 5, 1000]))
def test_components(spark, edges, last):
    components.LAST_LINKS, most = last, components.LAST_LINKS
    try:
        check_components(spark, edges)
    finally:
        components.LAST_LINKS = most


def check_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} if edges else {}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == linked
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in linked for y in linked)


@pytest.mark.parametrize("last", [0, 50, 10**6])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_LINKS", last)
    e = [(i, i + 1) for i in range(400)] + [(10_000, 10_001 + i) for i in range(200)] + [(1, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(401)}) == 1 and len({got[10_000 + i] for i in range(201)}) == 1 and len(set(got.values())) == 2


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(200)], "k string, v int")
    got = skew.lookup(left, right, "k").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {1: 500, 2: 200, None: 101}
    hot = skew.hot_keys(left, "k")
    got = skew.salted_join(left, right, "k", hot, F.col("i"), parts=7).groupBy("v").count().collect()
    assert hot == ["hot"] and {r.v: r["count"] for r in got} == {1: 500, 2: 200}


def sequential(texts, threshold=0.85, n=128, bands=16):
    """The plain rule: texts in order, each against the kept ones that share a band."""
    a, b = (np.array(x, np.uint64) for x in dedup.permutations(n))
    kept, sigs = [], []
    for i, t in enumerate(texts):
        g = dedup.shingles(t)
        s = np.array([min(((int(x) * int(p) + int(q)) % dedup.PRIME for x in g), default=dedup.PRIME) for p, q in zip(a, b)])
        near = [k for k in kept if any((s[j : j + n // bands] == sigs[k][j : j + n // bands]).all() for j in range(0, n, n // bands))]
        sigs.append(s)
        if not any((s == sigs[k]).mean() >= threshold for k in near):
            kept.append(i)
    return kept


@pytest.mark.parametrize("last", [0, 10**6])
def test_dedup_is_the_sequential_rule(spark, monkeypatch, last):
    monkeypatch.setattr(dedup, "LAST_PAIRS", last)
    rng = random.Random(3)
    texts = ["", "", "one two", "One, two!", None]
    for _ in range(25):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(1, 6)):
                v[rng.randrange(60)] = f"x{rng.randrange(300)}"
            texts.append(" ".join(v))
    rng.shuffle(texts)
    got = dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "i bigint, t string"), "i", "t").collect()
    assert sorted(r.i for r in got if r.kept) == sequential(texts) and len(got) == len(texts)


def test_groups_are_kept_or_dropped_whole(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    d = spark.createDataFrame([(0, "g", a), (1, "g", b), (2, "h", a), (3, "h", b), (4, "k", a), (5, "k", a + " other tail words here"), (6, None, b), (7, None, b)], "i bigint, g string, t string")
    got = {r.i: r.kept for r in dedup.dedup_groups(d, "g", "i", "t").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_top_up_prefers_existing_rows(spark, rows):
    old, new = spark.createDataFrame([("a", 1)], "id string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int")
    assert rows(dedup.top_up(old, new, "id")) == [("b", 3)]


@pytest.mark.parametrize("lengths,size", [(lambda r: r.integers(100, 900, 500), 1024), (lambda r: np.clip(r.lognormal(6.5, 0.7, 4000), 100, 3000).astype(int), 4096), (lambda r: r.integers(100, 3000, 3000), 4096)])
def test_windows_are_full_and_mixed(lengths, size):
    x = lengths(np.random.default_rng(0))
    w = pack.fill(x, size)
    load = np.bincount(w, weights=x)
    assert load.max() <= size and x.sum() / (len(load) * size) > 0.93
    assert len(pack.fill(np.zeros(0, int), 10)) == 0 and sorted(pack.fill(np.array([1024, 5, 5]), 1024)) == [0, 1, 1]


def test_packing_and_layout(spark):
    d = spark.createDataFrame([(f"e{i}", 1 + i % 9, list(range(1 + i % 9)), [1] * (1 + i % 9)) for i in range(200)] + [("long", 99, [], []), ("none", None, [], [])], "id string, n int, ids array<int>, mask array<tinyint>")
    p = pack.bin_pack(d, "id", "n", 16, group=60)
    assert p.count() == 200 and p.select("pack_group").distinct().count() > 1
    w = pack.lay_out(p.join(d.drop("n"), "id"), "ids", "mask", 16, pad=2).collect()
    assert all(len(r.ids) == len(r.mask) == 16 for r in w) and sum(sum(r.mask) for r in w) == sum(1 + i % 9 for i in range(200))
    s = pack.pack_stats(p, "n", 16).first()
    assert s["items"] == 200 and s.windows == len(w) and s.utilisation > 0.9


def test_split_keeps_groups_and_order(spark):
    d = spark.createDataFrame([(i, f"g{i % 40}") for i in range(400)], "i int, g string")
    got = split.validation_split(d, F.col("g"), 0.1).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and 40 <= sum(r.split == "val" for r in got) < 50
    more = split.validation_split(d.unionByName(spark.createDataFrame([(999, "new")], "i int, g string")), F.col("g"), 0.1).collect()
    assert sum(a.split != b.split for a, b in zip(sorted(got), sorted(x for x in more if x.g != "new"))) <= 10


TURN = "id string, tools string, state string, memory string, turns array<struct<role:string,text:string,think:string,calls:string,result:string>>"
GOOD = "a reason that is long enough"


def fault(spark, turns, state=None, memory=None, **options):
    o = {"bounds": (F.lit(1), F.lit(2)), "final_answer": F.lit(False), "needs_state": F.lit(False), "needs_memory": F.lit(False)} | options
    d = spark.createDataFrame([("i", '[{"name":"f","parameters":[]}]', state, memory, turns)], TURN)
    return validate.with_record_fault(d, "f", turns=F.col("turns"), tools=F.col("tools"), state=F.col("state"), memory=F.col("memory"), **o).first().f


def test_first_fault_of_a_record(spark):
    a = lambda think=GOOD, calls='[{"name":"answer"}]': ("assistant", None, think, calls, None)
    tool, user = ("tool", None, None, None, "{}"), ("user", "hi", None, None, None)
    assert fault(spark, [user, a()]) is None
    assert fault(spark, [user, a(), tool]) == "bad_turn_order" and fault(spark, []) == "bad_turn_order" and fault(spark, None) == "bad_turn_order"
    assert fault(spark, [a(), tool, a(), tool, a()]) == "turn_count_out_of_bounds"
    assert fault(spark, [a("short"), tool, a(calls=None)]) == "empty_think"
    assert fault(spark, [a(calls=None), tool, a("short")]) == "no_calls"
    assert fault(spark, [a("leaks </think> into the text")]) == "think_leaked_markup"
    assert fault(spark, [a(calls='[{"name":"f"}]')], final_answer=F.lit(True)) == "final_call_not_answer"
    assert fault(spark, [a()], needs_state=F.lit(True)) == "state_missing" and fault(spark, [a()], "{}") == "state_unexpected"
    assert fault(spark, [a()], None, '{"recent":[]}', needs_memory=F.lit(True)) == "memory_missing"
    assert fault(spark, [a()], None, '{"recent":["x"]}') == "memory_unexpected"


def test_generations_are_graded(spark):
    call = '[{"name":"f","arguments":{"n":5}}]'
    ok = f"<think>{GOOD}</think><response>{call}</response>"
    d = spark.createDataFrame([(1, ok, call.replace("5", "5.0")), (2, ok, call.replace("5", "6")), (3, "plain", call), (4, "<think>x</think>", call), (5, f"<think>{GOOD}</think>", call), (6, f"<think>{GOOD}</think><response>[]</response>", call), (7, None, call)], "i int, r string, e string")
    got = {r.i: (r.fault, r.correct) for r in validate.graded(d, "r", "e").collect()}
    assert got == {1: (None, True), 2: (None, False), 3: ("no_think", False), 4: ("short_think", False), 5: ("no_response", False), 6: ("empty_calls", False), 7: ("no_think", False)}
    t = [tuple(r) for r in validate.tally(validate.graded(d, "r", "e"), "fault", "i").collect()]
    assert t[0] == (None, 2, 2 / 7) and t[1] == ("no_think", 2, 2 / 7)


def test_pairs(spark):
    d = spark.createDataFrame([("p", "a", 1, "old"), ("p", "a", 3, "new"), ("p", "b", 2, None), ("q", "a", 1, "x"), (None, "a", 1, "y")], "pair string, branch string, at int, v string")
    got = {r.pair: r for r in pairs.pivot_pairs(d, "pair", "branch", "at", ["v"]).collect()}
    assert got["p"].a.v == "new" and got["p"].b is not None and got["p"].b.v is None and got["q"].b is None
    f = pairs.pair_faults(pairs.pivot_pairs(d, "pair", "branch", "at", ["v"]), [], {x: F.when(F.col(f"{x}.v").isNull(), "no_value") for x in "ab"})
    assert {r.pair: (r.fault_a, r.fault_b) for r in f.collect()} == {"p": ("partner_failed", "no_value"), "q": ("missing_branch", "missing_branch")}
    assert [tuple(r) for r in pairs.integrity(d, "pair", "branch").collect()] == [("q", ["a"])]
    g = spark.createDataFrame([("x", True), ("x", True), ("y", True), ("y", False), ("z", False), ("z", False), ("w", True), (None, True)], "g string, correct boolean")
    assert tuple(pairs.outcomes(g, "g").first()) == (3, 1, 1, 1, 1, 1 / 3)
    assert tuple(pairs.outcomes(g.where("false"), "g").first()) == (0, 0, 0, 0, 0, 0.0)


def test_planted_diagnosis(spark):
    def graded(rates):
        return spark.createDataFrame([("c", s, None, i < r * 40) for s, r in rates.items() for i in range(40)], "category string, subtype string, fault string, correct boolean")

    for train, val, want in (({"a": 0.3, "b": 0.2}, {"a": 0.3, "b": 0.2}, "capacity"), ({"a": 1.0, "b": 0.9}, {"a": 0.5, "b": 0.4}, "memorisation"), ({"a": 1.0, "b": 0.9}, {"a": 0.9, "b": 0.85}, "generalising"), ({"a": 1.0, "b": 0.2}, {"a": 1.0, "b": 0.0}, "uniform")):
        cells = diagnose.cell_report(graded(train), graded(val), graded(train), ["category", "subtype"])
        assert diagnose.memorisation_gap(cells).first().verdict == want
    assert diagnose.memorisation_gap(cells.where("false")).first().verdict == "not_measured"


def test_judges(spark):
    d = spark.createDataFrame([("x", 5, True), ("x", 4, False), ("x", None, True), ("y", 1, False)], "d string, s int, ok boolean")
    assert tuple(diagnose.calibration(d, F.col("s"), F.col("ok")).first()) == (3, 2 / 3, 1, 0, False)
    got = {r.d: r for r in diagnose.judge_summary(d, "d", "s").collect()}
    assert got["x"].n == 3 and got["x"].mean == 4.5 and got["x"].distribution == {4: 1, 5: 1} and got["y"].unparsed_rate == 0


def test_moving_average_in_blocks_is_the_plain_one(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.randrange(400), rng.random() * 9) for _ in range(700)]
    got = {}
    for r in order.ema(spark.createDataFrame(data, "run string, step int, v double"), "run", "step", "v", 0.3, rows=40).collect():
        got.setdefault(r.run, []).append((r.step, r.v, r.ema))
    for run in ("a", "b", None):
        last = None
        for (_, step, v), (s, x, e) in zip(sorted((r for r in data if r[0] == run), key=lambda r: r[1:]), sorted(got[run])):
            last = v if last is None else last + 0.3 * (v - last)
            assert (step, v) == (s, x) and abs(e - last) < 1e-9


def averages(data, alpha):
    """By run: its rows in order, null orders last, and the plain moving average beside them."""
    out = {}
    for run, step, v in sorted((r for r in data if r[2] is not None), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        rows = out.setdefault(run, [])
        rows.append((step, v, rows[-1][2] + alpha * (v - rows[-1][2]) if rows else v))
    return {run: sorted(rows, key=repr) for run, rows in out.items()}


def test_moving_averages_of_short_runs_are_exact_and_take_no_call_for_each(spark):
    rng = random.Random(14)
    data = [(rng.choice([None, *range(250)]), rng.choice([None, *range(90)]), rng.choice([None, rng.random() * 9])) for _ in range(3_000)]
    e = order.ema(spark.createDataFrame(data, "run bigint, step int, v double"), "run", "step", "v", rows=100)
    assert "FlatMapGroups" not in e._jdf.queryExecution().toString()
    got = {}
    for r in e.collect():
        got.setdefault(r.run, []).append((r.step, r.v, r.ema))
    assert {run: sorted(rows, key=repr) for run, rows in got.items()} == averages(data, 0.05)


def test_long_runs_beside_short_ones_are_averaged_in_blocks(spark):
    rng = random.Random(15)
    data = [(rng.choice(["hot", "hot", "hot", None, "inf", str(i % 100)]), rng.choice([None, *range(500)]), rng.random() * 9) for i in range(2_000)]
    data += [("inf", 250, float("inf")), ("alone", 1, 2.0)]
    e = order.ema(spark.createDataFrame(data, "run string, step int, v double"), "run", "step", "v", 0.2, rows=60)
    assert "BroadcastHashJoin" in e._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in e.collect():
        got.setdefault(r.run, []).append((r.step, r.v, r.ema))
    want = averages(data, 0.2)
    assert got.keys() == want.keys()
    for run, rows in got.items():
        for (s, v, x), (step, value, y) in zip(sorted(rows, key=repr), want[run], strict=True):
            assert (s, v) == (step, value) and (x == y or abs(x - y) < 1e-12 or x != x and y != y)


def test_ranks_in_blocks_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_ROWS", 30)
    rng = random.Random(5)
    data = [(i, rng.choice([rng.randrange(300), 7, None])) for i in range(600)]
    got = {r.i: r.r for r in stats.average_rank(spark.createDataFrame(data, "i int, v int"), "v", "r").collect()}
    values = sorted(v for _, v in data if v is not None)
    for i, v in data:
        assert got[i] == (None if v is None else values.index(v) + (values.count(v) + 1) / 2)


def test_items_that_fit_no_window_are_named(spark, rows):
    d = spark.createDataFrame([("a", 5), ("b", 17), ("c", None), ("d", -1), ("e", 16)], "id string, n int")
    assert rows(pack.refused(d, "id", "n", 16)) == [("b", 17, "too_long"), ("c", None, "no_length"), ("d", -1, "no_length")]


def test_paired_categories_refuse_a_verdict_on_one_record():
    validate.refuse_paired({"x": False, "p": True}, "x")
    with pytest.raises(ValueError, match="paired"):
        validate.refuse_paired({"x": False, "p": True}, "p")
    with pytest.raises(KeyError, match="one of p, x"):
        validate.refuse_paired({"x": False, "p": True}, "y")


def test_calls_of_every_turn_are_checked(spark):
    typed = '[{"name":"buy","parameters":{"properties":{"good":{"type":"string"},"n":{"type":"integer"}},"required":["good"]}},{"name":"look","parameters":["at"]}]'
    call = lambda name, **a: json.dumps([{"name": name, "arguments": a}])
    turn = lambda calls, think=GOOD: ("assistant", None, think, calls, None)
    tool = ("tool", None, None, None, "{}")
    bad = [(call("sell"), "undefined_tool"), (call("buy", n=1), "missing_required_arg"), (call("buy", good="x", m=1), "unknown_arg"), (call("buy", good="x", n="1"), "bad_arg_type"), (call("buy", good="x", n=True), "bad_arg_type"), ("[]", "no_calls"), ("no json", "no_calls"), ('[{"nome":1}]', "bad_shape"), ('[{"name":"buy","arguments":3}]', "bad_shape")]
    cases = [([turn(call("buy", good="x", n=1)), tool, turn(call("look", at=1)), tool, turn(call("answer", text="t"))], None)]
    cases += [([turn(call("buy", good="x")), tool, turn(c)], f) for c, f in bad]
    cases += [([turn(call("sell")), tool, turn("[]", "short")], "undefined_tool"), ([turn(call("sell"), "short"), tool, turn("[]")], "empty_think")]
    d = spark.createDataFrame([(str(i), typed, None, None, t) for i, (t, _) in enumerate(cases)], TURN)
    o = {"bounds": (F.lit(1), F.lit(3)), "final_answer": F.lit(False), "needs_state": F.lit(False), "needs_memory": F.lit(False)}
    got = validate.with_record_fault(d, "f", turns=F.col("turns"), tools=F.col("tools"), state=F.col("state"), memory=F.col("memory"), **o).collect()
    assert {int(r.id): r.f for r in got} == {i: f for i, (_, f) in enumerate(cases)}


def test_moving_average_and_retention(spark):
    d = spark.createDataFrame([("r", 2, 2.0), ("r", 1, 1.0), ("r", 3, None), ("q", 1, 5.0)], "run string, step int, v double")
    assert {(r.run, r.step): r.ema for r in order.ema(d, "run", "step", "v", 0.5).collect()} == {("r", 1): 1.0, ("r", 2): 1.5, ("q", 1): 5.0}
    c = spark.createDataFrame([(s,) for s in range(0, 1001, 30)], "step bigint")
    kept = {r.step for r in diagnose.retained(c, "step", 2, 30, 1000).collect() if r.kept}
    assert {960, 990} <= kept and {90, 120} <= kept and 60 not in kept


def test_dedup_in_cells_and_by_text_order(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(45):
        v = list(base)
        for _ in range(rng.randrange(12)):
            v[rng.randrange(80)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(v))
    named = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)], "i string, t string")
    monkeypatch.setattr(dedup, "LEADER_ROUNDS", 1)
    got = sorted(int(r.i[1:]) for r in dedup.dedup(named, "i", "t").collect() if r.kept)
    assert got == sequential(texts)
