"""Queries and flows over whole tables, against brute force."""

import collections

from millrace import queries
from millrace.operators import dedup
from millrace.plans import corpus


def test_pretraining_takes_every_recipes_share_of_all_documents(spark):
    size = {"a": [70, 41, 90, 5], "b": [33, 20], "c": [400]}
    docs = [(s, 10 * i + ord(s), "x" * n, 4) for s, sizes in size.items() for i, n in enumerate(sizes)] + [(None, 1, "y" * 41, 5), ("a", 2, "z" * 100, 1)]
    total = sum(len(t) for _, _, t, _ in docs)
    recipes = {"r": (1.2, 3, {"a": 5, "b": 5}), "q": (0.5, 1, {"a": 1, "b": 1, "c": 2})}
    config = [(r, s, w * 10**9, e, m) for r, (m, e, ws) in recipes.items() for s, w in ws.items()]
    d = spark.createDataFrame(docs, "source string, doc_id bigint, text string, int_score int")
    c = spark.createDataFrame(config, "config_id string, source_key string, budget_tokens bigint, xlam_epochs int, mix_ratio double")
    got = corpus.pretraining(d.where("source is not null"), corpus.recipe_budgets(d, c), corpus.CorpusConfig(ctx=16, mode="use_all"))
    rows = got.windows.collect()
    for r, (mix, epochs, ws) in recipes.items():
        for s, w in ws.items():
            take = min(int(total * mix * w / sum(ws.values())), epochs * sum(size[s])) // 16 * 16
            stream = [(e, 10 * i + ord(s), k) for e in range(epochs) for i, n in enumerate(size[s]) for k in range(n)][:take]
            mine = [(x.epoch, x.doc_id, x.window_id, x.taken) for x in rows if (x.config_id, x.source) == (r, s)]
            want = collections.Counter((e, i, at // 16) for at, (e, i, _) in enumerate(stream))
            assert {x[:3]: x[3] for x in mine} == want and len(mine) == len(want)
    windows = {(x.config_id, x.source, x.window_id) for x in rows}
    slots = got.slots.collect()
    assert {(x.config_id, x.source, x.window_id) for x in slots} == windows
    for r in recipes:
        assert sorted(x.slot for x in slots if x.config_id == r) == list(range(sum(w[0] == r for w in windows)))


def tables(monkeypatch, **frames):
    monkeypatch.setattr(queries, "table", lambda spark, d, name: frames[name])


def test_spellings_of_a_group_are_split_together(spark, rows, monkeypatch):
    spelt = lambda i, s: [f"Group {i}", f" group-{i}", f"GROUP__{i} "][s]
    data = [(100 * i + s, None, spelt(i, s), f"Spec-{i}" if s else f"spec {i}", spelt(i, s)) for i in range(60) for s in range(3)]
    data += [(10_000 + i, None, w, w, w) for i, w in enumerate(["N/A", "none", "-", "", "unknown", None] * 10)]
    o = spark.createDataFrame(data, "output_id bigint, loaded_utc timestamp, group_key string, spec_id string, subtype string")
    e = spark.createDataFrame([("SPEC 1",), ("spec_2 ",), ("none",), ("other",), (None,)], "spec_id string")
    r = spark.createDataFrame([("group 1",), ("N/A",), ("New one",), (None,)], "subtype string")
    tables(monkeypatch, outputs=o, examples=e, requests=r)
    got = {x.output_id: x.split for x in queries.group_split_plain(spark, "").collect()}
    assert len(got) == len(data) and all(len({got[100 * i + s] for s in range(3)}) == 1 for i in range(60))
    assert 24 <= sum(x == "val" for x in got.values()) <= 26
    assert len({got[10_000 + i] for i in range(0, 60, 6)} | {got[10_000 + i] for i in range(60)}) == 2  # not one block
    assert rows(queries.shared_specs_plain(spark, "")) == [("spec_1",), ("spec_2",)] and rows(queries.unscored_subtypes_plain(spark, "")) == [("new_one",)]


def test_spellings_of_a_source_are_one_sequence(spark, rows, monkeypatch):
    data = [(i, ["Edu Web", "edu_web", " EDU-web "][i % 3], "de fr", 3000, ["de", "DE", "de-DE", "en"][i % 4]) for i in range(12)] + [(20, "N/A", "x y", 9, "JA"), (21, None, "x", 9, None)]
    tables(monkeypatch, documents=spark.createDataFrame(data, "doc_id bigint, source string, text string, n_chars bigint, lang string"))
    assert rows(queries.token_budget_prefix_plain(spark, "")) == sorted([("edu_web", i, 2 * i, 2) for i in range(6)], key=repr)
    w = queries.window_cut_plain(spark, "").collect()
    assert sorted((x.source, x.window_id, x.tokens) for x in w) == [("edu_web", i, min(4096, 36000 - 4096 * i)) for i in range(9)]
    assert rows(queries.partition_scan_plain(spark, "")) == [("de", 9, 27000), ("ja", 1, 9)]


def test_additions_that_nearly_repeat_existing_rows_are_dropped(spark, rows):
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    old = spark.createDataFrame([("m", None, words("a")), ("z", "g", words("b")), ("y", "g", words("c"))], "id string, g string, t string")
    data = [("m", None, words("q")), ("b", None, words("a") + " more"), ("c", None, words("d")), ("d", None, words("d")), ("e", "h", words("c")), ("f", "h", words("b")), ("i", "k", words("b")), ("j", "k", words("e"))]
    new = spark.createDataFrame(data + data[2:3], "id string, g string, t string")
    assert {r.id for r in dedup.top_up_deduped(old, new, "id", "g", "t").collect()} == {"c", "i", "j"}  # h is the group of y and z again, k only in part
