"""Each operator against a brute-force version on small fixtures, and its defined results on odd input."""

import datetime as dt
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import leakage, mixing, neardup, packing, pieces, sampling, splits, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, item_id int, limit_id string"


def docs(spark, data):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", s, n, 7, 8, "x") for i, t, s, n in data], DOCS)


# 1


CONFIG = "config_id string, source_key string, budget_tokens bigint, xlam_epochs int, mix_ratio double"


def mix(spark, data, config):
    return mixing.mix_sources(docs(spark, data), spark.createDataFrame(config, CONFIG), F.col("source"), F.col("n_chars"), F.col("doc_id"))


def test_mix_reaches_shares_and_respects_caps(spark):
    data = [(i, "t", "a" if i % 3 else "b", 50 + i % 70) for i in range(3000)] + [(9000 + i, "t", None, 100) for i in range(50)]
    total = sum(x[3] for x in data)
    m = mix(spark, data, [("c", "a", 60, 2, 0.9), ("c", "b", 40, 2, 0.9), ("d", "b", 1, 1, 3.0), ("d", "none", 1, 5, 3.0)])
    plan = {(r.config_id, r.source_key): r for r in m.plan.collect()}
    got = {(r.config_id, r.source_key): (r.s, r.c) for r in m.records.groupBy("config_id", "source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("s"), F.max("copies").alias("c")).collect()}
    for s, share in (("a", 0.6), ("b", 0.4)):
        r = plan["c", s]
        assert r.reachable and abs(r.actual_size - share * 0.9 * total) <= 120 and got["c", s][0] == r.actual_size and got["c", s][1] <= 2
    assert plan["c", "b"].epochs == 1  # more than the source once, so records repeat
    assert not plan["d", "b"].reachable and got["d", "b"] == (plan["d", "b"].available, 1)
    assert not plan["d", "none"].reachable and plan["d", "none"].actual_size == 0 and ("d", "none") not in got


def test_mix_is_nested_and_needs_no_order(spark):
    data = [(i, "t", "a", 10) for i in range(2000)]
    m = mix(spark, data, [("small", "a", 1, 1, 0.2), ("large", "a", 1, 1, 0.5)])
    pick = {c: {r.record_key for r in m.records.where(F.col("config_id") == c).collect()} for c in ("small", "large")}
    assert pick["small"] < pick["large"] and len(pick["small"]) == 400 and len(pick["large"]) == 1000


def test_mix_of_odd_rows(spark, rows):
    assert rows(mix(spark, [], [("c", "a", 1, 1, 1.0)]).records) == []
    assert mix(spark, [(1, None, "a", None), (2, "x", "a", -5)], [("c", "a", 1, 1, 1.0), (None, "a", 1, 1, 1.0), ("c", None, 1, 1, 1.0), ("c", "b", None, None, None)]).plan.count() == 2
    same = mix(spark, [(None, "t", "a", 10)] * 100, [("c", "a", 1, 1, 0.5)])  # one key: together or not at all
    assert same.plan.first().actual_size in (0, 1000)


# 2


def brute_entities(data):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, g, s, _ in data:
        for k in (("g", g), ("s", s)):
            if k[1] is not None and i is not None:
                parent[find(("o", i))] = find(k)
    out = {}
    for i in {d[0] for d in data if d[0] is not None}:
        out.setdefault(find(("o", i)), set()).add(i)
    return {i: min(v) for v in out.values() for i in v}


def split(spark, data, fractions=(("train", 0.8), ("test", 0.2))):
    d = spark.createDataFrame([(*x, 1, "r") for x in data], "output_id bigint, g string, s string, category string, entity_id int, root string")
    return splits.split_records(d, spark.createDataFrame(fractions, "split_name string, fraction double"), F.col("output_id"), [F.col("g"), F.col("s")], F.col("category"))


def test_split_keeps_entities_and_fractions(spark):
    rng = np.random.default_rng(1)
    data = [(i, f"g{rng.integers(900)}" if rng.random() < 0.5 else None, f"s{rng.integers(900)}" if rng.random() < 0.4 else None, "abc"[rng.integers(3)] if i % 50 else None) for i in range(1500)]
    data += data[:40]  # repeated rows
    s = split(spark, data)
    got = s.records.collect()
    assert {r.record_id: r.entity_id for r in got} == brute_entities(data) and len(got) == 1500
    by = {}
    for r in got:
        by.setdefault(r.entity_id, set()).add(r.split_name)
    assert all(len(x) == 1 for x in by.values())
    for r in s.report.collect():
        assert abs(r["share"] - r.wanted) < 0.02 or r.label is None


def test_split_of_one_hot_key_and_chains(spark):
    data = [(i, "hot", None, "a") for i in range(300)] + [(1000 + i, f"c{i}", f"d{i // 2}" if i % 2 else f"d{(i + 1) // 2 - 1 if i else 0}", "b") for i in range(60)]
    assert {r.record_id: r.entity_id for r in split(spark, data).records.collect()} == brute_entities(data)


def test_split_of_odd_rows(spark):
    assert split(spark, []).records.count() == 0
    got = split(spark, [(None, "g", None, "a"), (1, "g", None, None), (2, "g", "s", "a"), (3, None, None, None)]).records.collect()
    assert {r.record_id: r.entity_id for r in got} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        split(spark, [(1, None, None, "a")], (("x", 0.0),))


# 3


TEXTS = ["Hello world's 123 tests\r\n\r\n  indented", "工場は在庫と注文を293個運んだ。", "", None, "a" * 3000, "  \t x  y\u3000z\u00a0", "naïve café — “quoted” ½ x²", "if x:\n    return 'it''s'\n"]


def test_token_totals_are_the_tokenizers(spark):
    data = [(i, t, ["a", "b", None][i % 3], 1) for i, t in enumerate(TEXTS * 3)]
    enc, _ = tokens.encoding(tokens.VOCABULARY)
    want = {}
    for _, t, s, _ in data:
        n, k = want.get(s, (0, 0))
        want[s] = n + 1, k + len(enc.encode_ordinary(t or ""))
    got = tokens.token_totals(docs(spark, data), {"source": F.col("source")}).collect()
    assert {r.source: (r.documents, r.tokens) for r in got} == want
    assert tokens.token_totals(docs(spark, []), {"source": F.col("source")}).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), min_size=1, max_size=5))
def test_token_totals_of_any_text(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select(F.aggregate(tokens.pieces(F.col("text")), F.lit(""), lambda a, x: F.concat(a, x)).alias("t")).collect()
    assert [r.t for r in got] == texts


def test_tokens_of_each_document(spark):
    enc, _ = tokens.encoding(tokens.VOCABULARY)
    d = docs(spark, [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[1], "s", 1), (None, "x y", "s", 1)])
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)} | {None: len(enc.encode_ordinary("x y"))}
    want[0] += want[1]
    assert {r.record_key: r.tokens for r in tokens.document_tokens(d, F.col("doc_id")).collect()} == want


def test_characters_that_the_jvm_does_not_know(spark):
    enc, _ = tokens.encoding(tokens.VOCABULARY)
    texts = ["a\U0001df25b \U0001df26 c", "x\U00011f04\U00011f05 1\U0001e4f0", "\u0378 \U000e0080", "plain text"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert tokens.token_totals(d, {"k": F.lit("k")}).first().tokens == sum(len(enc.encode_ordinary(t)) for t in texts)


# 4


def brute_pairs(data, threshold=0.6):
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def edited(rng, n):
    out = []
    for k in range(n):
        w = [f"w{rng.integers(60)}" for _ in range(rng.integers(3, 60))]
        out.append(" ".join(w))
        for _ in range(rng.integers(0, 4)):
            v = list(w)
            for _ in range(rng.integers(1, 4)):
                p = rng.integers(len(v))
                v[p : p + rng.integers(0, 2)] = [f"w{rng.integers(60)}"]
            out.append(" ".join(v))
    return out


def test_similar_sets_are_all_found(spark):
    texts = edited(np.random.default_rng(5), 120)
    data = [(f"i{k:04d}", t) for k, t in enumerate(texts)] + [("copy1", texts[0]), ("copy2", texts[0]), ("e1", ""), ("e2", None), ("short", "two words")]
    s = neardup.similar_sets(spark.createDataFrame(data, "id string, text string").withColumn("n", F.lit(1)).withColumn("k1", F.lit(2)))
    want = brute_pairs(data)
    got = [tuple(r) for r in s.pairs().collect()]
    assert set(got) == want and len(got) == len(want) > 100
    g = {r.id: r for r in s.groups().collect()}
    assert len(g) == len(data) and g["copy1"].class_id == g["copy2"].class_id == g["i0000"].class_id and g["copy1"].copies == 3
    assert g["e1"].class_id == "e1" and g["short"].links == 0
    for a, b in want:
        assert g[a].class_id == g[b].class_id


def test_hot_grams_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_GRAM", 8)
    monkeypatch.setattr(neardup, "BUCKET_SETS", 30)
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(20)]
    data = [(f"h{k:03d}", " ".join(base + [f"t{rng.integers(4)}" for _ in range(rng.integers(1, 6))])) for k in range(80)]
    got = {tuple(r) for r in neardup.similar_sets(spark.createDataFrame(data, "id string, text string")).pairs().collect()}
    assert got == brute_pairs(data)


def test_similar_sets_of_odd_rows(spark):
    assert neardup.similar_sets(spark.createDataFrame([], "id string, text string")).pairs().count() == 0
    long = " ".join(f"x{i}" for i in range(50_000))
    data = [("a", long), ("a", long), ("b", long + " tail"), (None, long)]
    s = neardup.similar_sets(spark.createDataFrame(data, "id string, text string"))
    assert [tuple(r) for r in s.pairs().collect()] == [("a", "b")]


# 5


def sample(spark, data, targets):
    r = spark.createDataFrame([(*x, "p", 1) for x in data], "id string, c string, d string, at timestamp, plan_id string, cell int")
    t = spark.createDataFrame(targets, "plan_id string, sample_fraction double, c string, d string, target_share double, min_rows int")
    return sampling.sample_cells(r, t, F.col("id"), {"c": F.col("c"), "d": F.col("d")}, F.col("at"))


def test_sample_meets_totals_floors_and_reports_gaps(spark):
    at = dt.datetime(2030, 1, 1)
    data = [(f"r{i}", "x" if i % 4 else "y", "m" if i % 3 else "n", at) for i in range(4000)] + [("rare", "z", "m", at), ("null", None, "m", at)]
    data += [("r1", "x", "n", at + dt.timedelta(1)), ("r1", "q", "n", at - dt.timedelta(1))]
    targets = [("p", 0.2, "x", "m", 0.31234, 0), ("p", 0.2, "x", "n", 0.2, 3), ("p", 0.2, "y", "m", 0.4, 0), ("p", 0.2, "z", "m", 0.0, 3), ("p", 0.2, None, "m", 0.01, 0), ("q", 1.0, "x", "m", 1.0, 0)]
    s = sample(spark, data, targets)
    n = 4002
    got = {}
    ids = [(r.plan_id, r.record_id) for r in s.records.collect()]
    assert len(ids) == len(set(ids))
    for r in s.records.collect():
        got[r.plan_id, r.c, r.d] = got.get((r.plan_id, r.c, r.d), 0) + 1
    for r in s.report.collect():
        assert abs(r.wanted - max(r.min_rows, r.target_share * (0.2 if r.plan_id == "p" else 1.0) * n)) < 1e-9
        drawn = got.get((r.plan_id, r.c, r.d), 0)
        goal = min(r.wanted, r.available)
        assert np.floor(goal - 1e-6) <= drawn <= np.ceil(goal + 1e-6)
        assert r.short == (r.available < r.wanted)
    assert {(r.plan_id, r.c) for r in s.report.where("short").collect()} == {("p", "z"), ("p", None), ("q", "x")}
    assert {tuple(r) for r in s.records.collect()} == {tuple(r) for r in sample(spark, data[::-1], targets).records.collect()}


def test_sample_of_odd_tables(spark):
    s = sample(spark, [], [("p", 0.5, "x", "m", 1.0, 2)])
    assert s.records.count() == 0 and s.report.first().short
    assert sample(spark, [("a", "x", "m", None), (None, "x", "m", None)], [("p", 1.0, "x", "m", 1.0, 0)]).records.count() == 1


def test_calibration_and_duels():
    n = np.array([100.0, 50, 0, 7, 3])
    t = np.array([10.0, 50, 0, 0, 2.5])
    assert np.allclose(sampling.calibrate(n, np.eye(5, dtype=bool), t, 0.3) * n, t)
    assert np.allclose(sampling.calibrate(n, np.eye(5, dtype=bool), t * 1.5, 0.3) * n, np.minimum(n, t * 1.5))
    rng = np.random.default_rng(0)
    hits = np.zeros(9)
    for k in range(4000):
        p = np.array((0.5, 0.3, 0.7, 0.1, 0.4, 0.2, 1.0, 0.0, 0.25))
        drawn, left, rest = sampling.duels(p, np.array([0] * 5 + [1] * 4), rng.integers(0, 2**62, 9), k)
        assert (drawn < 5).sum() == 2 and 6 in drawn and (left >= 5).all() and len(left) == 1 and abs(rest[0] - 0.45) < 1e-9
        hits[drawn] += 1
        hits[left] += rest
    assert np.allclose(hits / 4000, (0.5, 0.3, 0.7, 0.1, 0.4, 0.2, 1, 0, 0.25), atol=0.03)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.integers(2, 5), st.integers(0, 10**6))
def test_overlapping_margins_are_met_at_once(a, b, seed):
    """Totals that some probabilities have are met, and by those of the form of exponential tilting: odds ratios are those of equal chances."""
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 500, a * b).astype(float)
    p = rng.random(a)[:, None] * rng.random(b)[None, :] * 0.9 + 0.01 * rng.random((a, b))
    member = np.array([np.repeat(np.arange(a), b) == i for i in range(a)] + [np.tile(np.arange(b), a) == j for j in range(b)])
    totals = member @ (n * p.ravel())
    got = sampling.calibrate(n, member, totals, 0.4)
    if got.max() < 1:
        assert np.allclose(member @ (n * got), totals, rtol=1e-6)
        w = np.log(got).reshape(a, b)
        assert np.allclose(w - w[:1] - w[:, :1] + w[0, 0], 0, atol=1e-5)


def test_sample_of_margins(spark):
    at = dt.datetime(2030, 1, 1)
    data = [(f"r{i}", "xyz"[i % 3 if i % 7 else 0], "mn"[i % 2 if i % 5 else 0], at) for i in range(3000)] + [("none", None, "m", at)]
    r = spark.createDataFrame([(*x, "p", "v") for x in data], "id string, c string, d string, at timestamp, plan_id string, value string")
    ask = [("p", 0.2, "c", "x", 0.2, 0), ("p", 0.2, "c", "y", 0.5, 0), ("p", 0.2, "c", "z", 0.3, 0), ("p", 0.2, "d", "m", 0.4, 0), ("p", 0.2, "d", "n", 0.6, 0), ("p", 0.2, "d", None, 0.0, 1), ("q", 1.0, "c", "x", 0.9, 0), ("q", 1.0, "e", "x", 0.1, 0)]
    t = spark.createDataFrame(ask, "plan_id string, sample_fraction double, dimension string, value string, target_share double, min_rows int")
    s = sampling.sample_margins(r, t, F.col("id"), {"c": F.col("c"), "d": F.col("d")}, F.col("at"))
    rows = s.records.collect()
    assert len({(x.plan_id, x.record_id) for x in rows}) == len(rows)
    for m in s.report.collect():
        if m.plan_id == "p" and m.value is not None:
            drawn = sum(x.plan_id == "p" and x[m.dimension] == m.value for x in rows)
            assert not m.short and abs(m.expected - m.wanted) < 1e-3 and abs(drawn - m.wanted) <= 4, m
    assert {(m.plan_id, m.dimension, m.value) for m in s.report.where("short").collect()} == {("p", "d", None), ("q", "c", "x"), ("q", "e", "x")}
    assert abs(sum(x.plan_id == "p" for x in rows) - 0.2 * 3001) <= 1
    empty = sampling.sample_margins(r.where("false"), t, F.col("id"), {"c": F.col("c"), "d": F.col("d")}, F.col("at"))
    assert empty.records.count() == 0 and empty.report.where("short").count() == 1


# 6


LIMITS = "limit_id string, capacity_tokens int, overlap_tokens int, n int"


def limits(spark, data):
    return spark.createDataFrame([(*x, 1) for x in data], LIMITS)


def test_packing_holds_every_document_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 400, 3000), rng.lognormal(5, 1, 2000).astype(int), [100] * 3000, [0, 1000, 1001, 2500, 1, 1]]).tolist()
    d = docs(spark, [(i, "é" * (n // 2) + "x" * (n % 2), "s", n) for i, n in enumerate(sizes)])
    monkeypatch.setattr(packing, "SHARD", 2000)
    monkeypatch.setattr(packing, "AT_ONCE", 1)
    p = packing.pack(d, limits(spark, [("a", 1000, 10), ("b", 333, 0)]))
    for name, cap in (("a", 1000), ("b", 333)):
        r = p.items.where(F.col("limit_id") == name).toPandas()
        size = r.end_token - r.start_token
        load = size.groupby(r.container_id).sum()
        assert load.max() <= cap
        assert (size.groupby(r.doc_id).sum().reindex(range(len(sizes))) == sizes).all()
        whole = r.doc_id.map(lambda i: sizes[i]) <= cap
        assert (r[whole].groupby("doc_id").size() == 1).all()  # nothing that fits is cut
        assert ((size == cap) | (r.end_token == r.doc_id.map(lambda i: sizes[i]))).all()
        rep = p.report.where(F.col("limit_id") == name).first()
        assert rep.containers == len(load.drop("empty")) and rep.containers >= rep.lower_bound - 1e-9
        assert rep.utilisation > 0.97


def test_packing_of_odd_tables(spark):
    assert packing.pack(docs(spark, []), limits(spark, [("a", 100, 0)])).items.count() == 0
    d = docs(spark, [(1, None, "s", 0), (2, "", "s", 0), (3, "abc", "s", 0), (3, "abcd", "s", 0), (None, "abc", "s", 0), (4, "x" * 300_000, "s", 0)])
    r = {(x.doc_id, x.piece_no): x for x in packing.pack(d, limits(spark, [("a", 1000, 0)])).items.collect()}
    assert r[1, 0].container_id == r[2, 0].container_id == "empty" and r[3, 0].end_token == 4 and len([k for k in r if k[0] == 4]) == 300
    assert packing.pack(d, limits(spark, [])).items.count() == 0


@pytest.mark.parametrize("lo,hi,most", [(0.34, 0.4, 1.001), (0.51, 0.6, 1.001), (0.26, 0.33, 1.001), (0.02, 0.98, 1.02)])  # the last has two sizes in a class
def test_containers_are_near_the_bound_of_the_linear_program(lo, hi, most):
    size = np.arange(int(lo * 1000), int(hi * 1000))
    h = pd.DataFrame({"limit_id": "x", "c": 1000, "size": size, "count": 200, "full": 0, "tokens": size * 200})
    r = packing._solve_limit(h)
    total = r[r.kind == "total"].iloc[0]
    assert total.a == 200 * len(size) and total.bound <= total.c + 1e-9 and total.c <= most * total.bound + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_bound_of_containers_is_one(sizes):
    """The bound is not above the fewest containers, found by going through all packings."""
    size, count = (np.array(x) for x in zip(*sorted(sizes)))
    ready = packing.ready_prices(size, count, 12)
    assert packing.worth_at_most(size, count, ready, 12) <= 1 + 1e-9
    items = tuple(sorted((s for s, n in sizes for _ in range(n)), reverse=True))

    def fewest(left, rooms, best):
        if len(rooms) >= best:
            return best
        if not left:
            return len(rooms)
        for i in {r: k for k, r in enumerate(rooms) if r >= left[0]}.values():
            best = min(best, fewest(left[1:], rooms[:i] + (rooms[i] - left[0],) + rooms[i + 1 :], best))
        return min(best, fewest(left[1:], (*rooms, 12 - left[0]), best))

    if len(items) <= 9:
        h = pd.DataFrame({"limit_id": "x", "c": 12, "size": size, "count": count, "full": 0, "tokens": size * count})
        total = packing._solve_limit(h)
        assert total[total.kind == "total"].iloc[0].bound <= fewest(items, (), 99) + 1e-9 <= total[total.kind == "total"].iloc[0].c + 1e-9


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size, price, most = rng.integers(1, 12, 4), rng.random(4), rng.integers(0, 4, 4)
        best = max(((np.array([a, b, c, e]) * price).sum() for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) for e in range(most[3] + 1) if (np.array([a, b, c, e]) * size).sum() <= 20), default=0)
        got = packing._knapsack(size, price, most, 20)
        assert (got * size).sum() <= 20 and (got <= most).all() and abs((got * price).sum() - best) < 1e-9


# 7


def norm(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", re.sub("[­​‌⁠]", "", t or "")).lower())


def brute_leaks(data, items, run):
    out = set()
    for j, t in items:
        w = norm(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, x in data:
            v = norm(x)
            if i is not None and j is not None and any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((i, j))
    return out


def test_leaks_are_all_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: f"v{rng.integers(40)}"
    items = [(j, " ".join(word() for _ in range(rng.integers(5, 40)))) for j in range(70)] + [(100, None), (None, "x y z"), (101, "ein zwei drei vier fünf sechs")]
    data = []
    for i in range(150):
        w = [word() for _ in range(rng.integers(0, 200))]
        if i % 3 == 0:
            v = (items[rng.integers(70)][1] or "").split()
            n = rng.integers(4, 9)
            at = rng.integers(0, max(1, len(v) - n))
            w[len(w) // 2 : len(w) // 2] = v[at : at + n]
        data.append((i, ["  ", "\n", " - "][i % 3].join(w).upper()))
    data += [(500, "Ein, zwei​ DREI; vi­er (ｆünf) sechs"), (501, None), (502, ""), (None, items[0][1])]
    d = docs(spark, [(i, t, "s", 0) for i, t in data])
    it = spark.createDataFrame([(j, t, "q", 3) for j, t in items], "item_id bigint, text string, lang string, doc_id int")
    for run in (6, 7):
        got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, it, run).collect()]
        want = brute_leaks(data, items, run)
        assert len(got) == len(want) and set(got) == want and want
    assert (500, 101) in brute_leaks(data, items, 6)
    monkeypatch.setattr(leakage, "INDEX_BYTES", 1500)  # several indexes
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, it, 6).collect()} == brute_leaks(data, items, 6)
    assert leakage.leaks(d, it.where("false"), 6).count() == 0 and leakage.leaks(docs(spark, []), it, 6).count() == 0


def test_wand_retrieves_what_scoring_all_items_does():
    rng = np.random.default_rng(9)
    for block in (1, 3, 16):
        leakage.BLOCK, kept = block, leakage.BLOCK
        items = [(j, " ".join(f"v{int(x)}" for x in rng.zipf(1.3, rng.integers(12, 40)) % 60), None) for j in range(90)]
        x = leakage.build_index(items, 12)
        leakage.BLOCK = kept
        lists = len(x.end) - 1
        dense = np.zeros((lists + 1, len(x.ids)))
        for k in range(lists):
            for a in range(x.end[k - 1] if k else 0, x.end[k]):
                dense[k, x.at[a] - k * len(x.ids)] = x.impact[a]
        terms = np.full((300, leakage.PASSAGE), lists)
        for r in terms:
            own = np.unique(rng.integers(0, lists, rng.integers(1, leakage.PASSAGE)))
            r[: len(own)] = own
        got = set(zip(*(z.tolist() for z in leakage.retrieve(x, terms))))
        score = dense[terms].sum(axis=1)
        assert {(p, i) for p, i in zip(*(z.tolist() for z in np.nonzero(score >= 1.001)))} <= got <= {(p, i) for p, i in zip(*(z.tolist() for z in np.nonzero(score >= 0.998)))} and len(got) > 100


def test_questions_and_answers_are_told_apart(spark):
    q = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(1, q, '[{"name":"f","n":7}]', "s"), (2, q.replace("q", "r"), None, "s"), (3, "too short", "x", "t")], "item_id bigint, text string, expected string, suite string")
    data = [(1, q + " and then name F, n 7.", "", 0), (2, " ".join(q.split()[:12]), "", 0), (3, q.replace("q", "r"), "", 0), (1, "other row", "", 0)]
    found = leakage.leaks(docs(spark, data), items, item_answer="expected")
    assert {(r.doc_id, r.item_id): (round(r.question_share, 6), r.answer) for r in found.collect()} == {(1, 1): (1.0, True), (2, 1): (round(1 / 3, 6), False), (3, 2): (1.0, None)}
    assert {tuple(r) for r in leakage.leaked_items(found, items).collect()} == {(1, "s", 2, 1, True), (2, "s", 1, 0, True), (3, "t", 0, 0, False)}


# 8


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.# \n\t\ré。工", max_size=600), st.integers(24, 120), st.integers(0, 12))
def test_pieces_cover_fit_and_overlap(text, capacity, overlap):
    parts, stretch = pieces.split_text(text, capacity, overlap)
    b = text.encode()
    assert stretch == any(len(x.encode()) > capacity for x in re.split("[ \t\n\r。]", text))
    if not b:
        assert parts == []
        return
    assert parts[0][0] == 0 and parts[-1][1] == len(b) and (len(parts) == 1) == (len(b) <= capacity)
    for s, e, _ in parts:
        assert 0 < e - s <= capacity
        b[s:e].decode()
    for (_, e, _), (s, f, _) in zip(parts, parts[1:]):
        assert f > e and (overlap <= e - s <= overlap + 3 or s == 0)


def test_pieces_cut_at_the_coarsest_boundary():
    section = lambda h, n: f"# {h}\n" + "some words here. " * n + "\n\n"
    parts, _ = pieces.split_text(section("one", 20) + section("two", 20) + section("three", 20), 500, 20)
    assert [k for *_, k in parts] == ["heading", "heading", "end"]
    parts, stretch = pieces.split_text("x" * 1000, 300, 10)
    assert stretch and {k for *_, k in parts} == {"forced", "end"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# A\n", "## b\n\n", "Title\n=====\n", "- one\n", "  - two two\n", "    * three\n", "1. x y\n", "```\n", "code # no\n", "<a>\n", "</a>\n", "<b k='v'>", "</b>", "<c/>", "| x | y |\n", "\n", "text. More text! ", "工場。", "é" * 30 + "\r\n", "x" * 40, "def f(a):\n", "import os\n"]), max_size=50), st.integers(24, 120), st.integers(0, 12))
def test_pieces_of_any_structure_cover_and_fit(parts, capacity, overlap):
    text = "".join(parts)
    b, (cut, _) = text.encode(), pieces.split_text(text, capacity, overlap)
    assert [e for _, e, _ in cut][-1:] == [len(b)][: len(cut)] and b[cut[0][0] : cut[0][0] + 1] == b[:1] if cut else not b
    for (s, e, _), (t, f, _) in zip(cut, [*cut[1:], (None, None, None)]):
        assert 0 < e - s <= capacity and (t is None or f > e and (overlap <= e - t <= overlap + 3 or t == 0))
        b[s:e].decode()
    tree = pieces._Tree(b)  # children cover their node
    stack = [(0, len(b), "section")]
    for node in stack:
        below = [c for c, _ in tree.children(node)]
        if below:
            assert (below[0][0], below[-1][1]) == node[:2] and all(x[1] == y[0] for x, y in zip(below, below[1:])) and all(x[0] < x[1] for x in below)
            stack += [c for c in below if c[1] - c[0] < node[1] - node[0]]


def kinds(text, capacity):
    cut, _ = pieces.split_text(text, capacity, 0)
    return [text.encode()[s:e].decode() for s, e, _ in cut], [k for *_, k in cut]


def test_structure_that_pieces_follow():
    words = "some words here "
    items = "".join(f"- item {i} {words}\n" + "".join(f"  - sub {i}{j} {words}\n" for j in range(3)) for i in range(4))
    got, how = kinds("Intro\n\n" + items, 130)
    assert how == ["item"] * 3 + ["end"] and all(x.startswith("- item") for x in got[1:])  # an item stays with those below it
    got, how = kinds(items, 60)
    assert set(how) == {"item", "end"}
    got, how = kinds("One\n===\n" + words * 6 + "\n\nTwo\n---\n" + words * 6 + "\n\nThree\n===\n" + words * 6, 150)
    assert how == ["heading", "heading", "end"] and got[1].startswith("Two\n---") and got[2].startswith("Three")
    fenced = "```\n# no heading\n\nx = 1\n```\n\n"
    got, how = kinds("# A\n\n" + words * 4 + "\n\n" + fenced + words * 5, 110)
    assert any(fenced.strip() in x for x in got) and "heading" not in how
    got, how = kinds("<doc>\n<p>" + words * 4 + "</p>\n\n<p>" + words * 4 + "\n\nmore</p>\n<p>" + words * 4 + "</p>\n</doc>", 100)
    assert how[:-1] == ["element"] * (len(how) - 1) and sum(x.count("</p>") == x.count("<p>") for x in got) == len(got)
    code = "import os\n\n" + "".join(f"# a comment\n\ndef f{i}(a):\n    # inside\n    return a\n\n" for i in range(6))
    got, how = kinds(code, 130)
    assert set(how) == {"heading", "end"} and all(x.startswith("def") for x in got[1:])
    deep = "".join(f"<n{i}>" for i in range(3000)) + words + "".join(f"</n{i}>" for i in reversed(range(3000)))
    assert all(len(x) <= 200 for x in kinds(deep, 200)[0])


def test_pieces_of_odd_rows(spark):
    d = docs(spark, [(1, None, "s", 0), (2, "", "s", 0), (3, "y" * 200_000, "s", 0), (None, "word " * 50, "s", 0), (4, "z" * 100, "s", 0), (5, "word " * 50, "s", 0), (5, "word " * 50, "s", 0)])
    p = pieces.split_oversized(d, limits(spark, [("a", 100, 10), (None, 50, 5)]))
    got = {(r.doc_id, r.case_kind) for r in pieces.oversized_cases(p).collect()}
    assert got == {(3, "over"), (3, "run"), (None, "over"), (5, "over")}
    assert pieces.split_oversized(docs(spark, []), limits(spark, [("a", 100, 10)])).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(d, limits(spark, [("a", 100, 99)]))


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 4), (3, 8)])
def test_prefix_trees_cut_no_similar_pair(seed, depth, monkeypatch):
    """One bucket with all n-grams: all pairs that reach the threshold are left, and few others."""
    monkeypatch.setattr(neardup, "DEPTH", depth)
    monkeypatch.setattr(neardup, "AT_ONCE", 50)
    texts = edited(np.random.default_rng(seed), 150)
    class Held:
        value = np.full(1 << 21, 12, np.uint8)

    source = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    routed = list(neardup._route(Held, 21, 1, 3, 0.6)(iter([source])))
    got = {tuple(sorted((r[:2], r[2:]))) for b in neardup._join(0.6)(iter(routed)) for r in zip(*(c.to_pylist() for c in b.columns))}
    h, n = neardup.gram_sets(texts, 3)
    keys = list(zip(*(k.tolist() for k in neardup._class_keys(h, n))))
    sets = dict(zip(keys, (frozenset(h[s : s + m].tolist()) for s, m in zip(np.cumsum(n) - n, n))))
    want = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert want <= got and len(want) > 50 and len(got) < 2 * len(want)
