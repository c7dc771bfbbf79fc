"""Plans, checks, sinks and streams beside the queries."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import support
from millrace.functions import jsonx, render, stats, text
from millrace.operators import checks, diagnose, judge, pairs, plan, validate
from millrace.plans import corpus
from millrace.sources import readers, sinks
from millrace.streaming import ingest


def test_shares_are_checked():
    plan.check_shares({"a": 0.4, "b": 0.6}, ["a", "b"])
    for bad, what in (({"a": 0.4, "c": 0.6}, "unknown categories: c"), ({"a": 0.4, "b": 0.5}, "not to 1"), ({"a": -0.5, "b": 1.5}, "negative: a")):
        with pytest.raises(ValueError, match=what):
            plan.check_shares(bad, ["a", "b"])


def test_a_capped_plan_is_a_part_of_the_whole_one(spark):
    s = spark.createDataFrame([("x", 17, ["d", "e"], ["s", "t", "u"]), ("y", 3, [], None), ("z", None, ["d"], ["s"])], "category string, planned int, domains array<string>, subtypes array<string>")
    whole = {tuple(r) for r in plan.unpaired(s).collect()}
    capped = {tuple(r) for r in plan.unpaired(s, 2).collect()}
    assert len(whole) == 20 and capped < whole and len(capped) == 12 + 2
    assert {(r[3], r[4]) for r in whole if r[0] == "x"} == {(d, t) for d in "de" for t in "stu"} and {r[3:] for r in whole if r[0] == "y"} == {(None, None)}
    p = plan.paired(s, 4).collect()
    assert len(p) == 8 + 2 and sorted(r.branch for r in p if r.pair_id == "pair-000000000" and r.category == "x") == ["a", "b"]


def test_tools_are_drawn_by_key(spark):
    d = spark.createDataFrame([(f"k{i}", ["must"], ["never"]) for i in range(50)], "k string, inc array<string>, exc array<string>")
    pool = F.array(*[F.lit(x) for x in ("a", "b", "c", "d", "never", "must")])
    got = [r.t for r in d.select(plan.sampled_tools(pool, F.col("k"), F.lit(3), F.col("inc"), F.col("exc")).alias("t")).collect()]
    assert all(len(set(t)) == 3 and "must" in t and "never" not in t for t in got) and len({tuple(t) for t in got}) > 3
    assert spark.range(1).select(plan.sampled_tools(pool, F.lit("k"), F.lit(99)).alias("t")).first().t == ["a", "b", "c", "d", "must", "never"]


def test_checks_name_what_is_wrong(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("z", 1)], "k string, n int")
    assert rows(checks.compared(a.where("k is not null"), b, "k", "n")) == sorted([("x", 1, 1, "equal"), ("y", 2, 3, "differs"), ("z", None, 1, "not_recorded")], key=repr)
    checks.assert_counts(a.where("k = 'x'"), b.where("k = 'x'"), "k", "n")
    with pytest.raises(checks.CheckFailed, match="y, z"):
        checks.assert_counts(a.where("k is not null"), b, "k", "n")
    with pytest.raises(checks.CheckFailed, match="both in training and held out: x, y"):
        checks.assert_no_leak(a, b, "k")
    checks.assert_no_leak(a.where("k is null"), b, "k")
    assert rows(checks.unmatched(b.unionByName(b), a, "k")) == [("z", 2)] and rows(checks.unmatched(a, b, "k")) == [(None, 1)]


def test_partitions_of_other_values_are_not_read(spark, tmp_path):
    d = spark.createDataFrame([(i, ["de", "fr", "ja"][i % 3]) for i in range(90)], "i int, lang string")
    readers.write_partitioned(d, f"{tmp_path}/t", "lang")
    got = readers.partition_scan(spark, f"{tmp_path}/t", "lang", ["de", "fr"])
    assert got.count() == 60 and sorted(r.lang for r in got.select("lang").distinct().collect()) == ["de", "fr"]
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [lang" in plan_text


def test_restore_copies_what_is_missing(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/remote")
    assert sinks.restore_if_absent(f"{tmp_path}/remote", f"{tmp_path}/local") and spark.read.parquet(f"{tmp_path}/local").count() == 5
    assert not sinks.restore_if_absent(f"{tmp_path}/none", f"{tmp_path}/local")
    with pytest.raises(FileNotFoundError):
        sinks.restore_if_absent(f"{tmp_path}/none", f"{tmp_path}/other")


def test_diagnostics_and_corpus_are_written_whole(spark, tmp_path):
    g = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    sinks.write_diagnostics({"n": g.groupBy("text").count()}, g, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d/generations").count() == 2
    doc = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/d/report").collect()))
    assert sorted(x["count"] for x in doc["n"]) == [1, 1]
    with pytest.raises(ValueError, match="no report"):
        sinks.write_diagnostics({"n": g}, g, f"{tmp_path}/e", most=1)
    w = spark.createDataFrame([("a", i // 2, 10) for i in range(8)], "source string, window_id bigint, taken int")
    slots = spark.createDataFrame([("a", i, 3 - i) for i in range(4)], "source string, window_id bigint, slot bigint")
    assert sinks.write_corpus(w, slots, f"{tmp_path}/c", ["source", "window_id"]) == 8
    assert spark.read.json(f"{tmp_path}/c/manifest").first().asDict() == {"source": "a", "windows": 4, "tokens": 80}


def test_near_duplicates_of_a_stream(spark, tmp_path):
    words = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    parts = [[("a", words("x")), ("b", words("y"))], [("c", words("x") + " more"), ("d", words("z"))], [("e", words("y")), ("f", words("x") + " more")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "id string, t string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    s = spark.readStream.schema("id string, t string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    q = ingest.near_duplicates(s, "id", F.col("t")).writeStream.format("memory").queryName("near").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.d for r in spark.table("near").groupBy("id").agg(F.max("duplicate_of").alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    assert got["a"] is None and got["b"] is None and got["d"] is None and got["c"] == "a" and got["e"] == "b" and got["f"] in ("a", "c") and len(got) == 6


def test_small_reports_and_peaks(spark):
    d = spark.createDataFrame([("one", 1.5), ("two", None)], "name string, x double")
    assert diagnose.as_table(d).splitlines() == ["name    x", "one   1.5", "two     -"] and diagnose.as_table(d, 1).endswith("...")
    peaks = {"NVIDIA RTX PRO 6000": 500.0, "H100 80GB HBM3 SXM": 989.0, "NVIDIA H100 PCIe": 756.0, "NVIDIA L4": 121.0, "NVIDIA L40S": 181.0, "RTX 6000 Ada Generation": 182.0, "unknown": 989.0, "Tesla T4": 65.0}
    got = spark.createDataFrame([(x,) for x in peaks], "d string").select("d", stats.peak_tflops(F.col("d")).alias("p")).collect()
    assert {r.d: r.p for r in got} == peaks
    assert spark.range(1).select(render.changed_lines(F.lit("a\nb\nc"), F.lit("a\nx"))).first()[0] == [2, 3]


def test_functions_of_one_column(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()[:]
    labels = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(stats.scored_tokens(labels(5, -100, 7, 8)), stats.scored_tokens(labels(5)), stats.scored_tokens(F.array().cast("array<int>"))) == (2, 0, 0)
    assert one(render.with_end(labels(1, 2)), render.with_end(labels(), 9)) == ([1, 2, render.END], [9])
    assert one(text.eta(F.lit(59)), text.eta(F.lit(3725)), text.eta(F.lit(61.9))) == ("0m 59s", "1h 02m", "1m 01s")
    assert one(text.shortened(F.lit("abcdef"), 3), text.shortened(F.lit("abc"), 3), text.mentions(F.lit("use load_x now"), F.lit("load_x")), text.mentions(F.lit("use load_xy"), F.lit("load_x"))) == ("abc ...[truncated]", "abc", True, False)
    assert one(jsonx.sorted_json(F.lit('{"b": 1, "a": [2]}')), jsonx.sorted_json(F.lit("no json")), jsonx.extract_object(F.lit('Here: {"a": "}"} rest'))) == ('{"a":[2],"b":1}', "no json", '{"a": "}"}')
    assert one(jsonx.diff_paths(F.lit('{"a/b": {"~": 1}}'), F.lit('{"a/b": {"~": 2}}'))) == (["/a~1b/~0"],)
    assert one(stats.mfu(F.lit(1e6), F.lit(1e8), F.lit(1200.0)), stats.mfu(F.lit(1.0), F.lit(1.0), F.lit(0.0))) == (50.0, None)
    slots = [r[0] for r in spark.range(400).select(render.slot(F.col("id"))).collect()]
    assert 150 < sum(slots) < 250 and slots == [r[0] for r in spark.range(400).repartition(3).orderBy("id").select(render.slot(F.col("id"))).collect()]


def test_generations_from_outside_in(spark):
    tools = '[{"name":"f","parameters":{"properties":{"n":{"type":"integer"}},"required":["n"]}}]'
    think = "<think>long enough to count</think>"
    cases = [("", "no_think"), ("<think>short</think>", "short_think"), (think, "no_response"), (think + "<response>[]</response>", "empty_calls"), (think + '<response>[{"name":"g"}]</response>', "undefined_tool"), (think + '<response>[{"name":"f"}]</response>', "missing_required_arg"), (think + '<response>[{"name":"f","arguments":{"n":1}}]</response>', None), (None, "no_think")]
    d = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert {r.i: r.f for r in d.select("i", validate.generation_fault(F.col("x"), F.lit(tools)).alias("f")).collect()} == {i: f for i, (_, f) in enumerate(cases)}


def test_places_names_and_workers(spark):
    at = sinks.Layout("s3://bucket/run")
    assert (at.source("web"), at.shard("x"), at.combined, at.split("val"), at.stats) == ("s3://bucket/run/sources/web", "s3://bucket/run/raw/category=x", "s3://bucket/run/combined", "s3://bucket/run/windows/split=val", "s3://bucket/run/stats.json")
    got = [{r.id for r in readers.worker_shard(spark.range(10), "id", 3, w).collect()} for w in range(3)]
    assert set.union(*got) == set(range(10)) and sum(map(len, got)) == 10 and got[1] == {1, 4, 7}


def test_documents_are_replaced_whole(spark, tmp_path):
    for n in (1, 2):
        sinks.write_json({"n": n, "é": "x"}, f"{tmp_path}/a/b.json")
    assert readers.load_json(f"{tmp_path}/a/b.json") == {"n": 2, "é": "x"} and [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["b.json"]


def test_branches_that_win_alone(spark, rows):
    g = spark.createDataFrame([("x", "a", True), ("x", "b", False), ("y", "a", True), ("y", "b", False), ("z", "b", True), ("z", "a", False), ("w", "a", True), ("w", "b", True), ("v", "a", True)], "g string, branch string, correct boolean")
    assert rows(pairs.branch_bias(g, "g", "branch")) == [("a", 2, 2 / 3), ("b", 1, 2 / 3)]


def test_versions_outside_their_window():
    windows = {"spark": ">=4.0,<5", "frame": ">=2"}
    support.require(windows, {"spark": "4.1.2", "frame": "2.0"})
    assert set(support.outside(windows, {"spark": "5.0", "frame": None})) == {"spark", "frame"}
    with pytest.raises(support.Unsupported, match='frame is missing: install "frame>=2"; spark 3.5 is outside'):
        support.require(windows, {"spark": "3.5"})
    assert support.outside({"pyspark": ">=4", "no-such-package": ">=1"}).keys() == {"no-such-package"}


def test_probes_keep_their_errors(spark):
    def ask(p):
        if p == "bad":
            raise KeyError("gone")
        return p.upper()

    d = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "i int, prompt string")
    assert {r.i: (r.reply, r.error) for r in judge.run_probes(d, "prompt", ask).collect()} == {1: ("X", None), 2: (None, "KeyError: 'gone'"), 3: ("Y", None)}


def test_pairs_differ_in_the_state_alone(spark):
    row = lambda p, b, s, m="m", r="r": (p, b, 1, s, m, r)
    data = [row("ok", "a", '{"x":1,"y":2}'), row("ok", "b", '{"x":3,"y":2}'), row("mem", "a", '{"x":1}', "m1"), row("mem", "b", '{"x":1}', "m2"), row("same", "a", '{"x":1}'), row("same", "b", '{"x":1}'), row("two", "a", '{"x":1,"y":2}'), row("two", "b", '{"x":2,"y":1}'), row("req", "a", '{"x":1}', r="p"), row("req", "b", '{"x":2}', r="q"), row("half", "a", '{"x":1}')]
    p = pairs.pivot_pairs(spark.createDataFrame(data, "p string, branch string, at int, state string, memory string, request string"), "p", "branch", "at", ["state", "memory", "request"])
    f = pairs.pair_faults(p, pairs.swap_checks(), {x: F.lit(None).cast("string") for x in "ab"})
    assert {r.p: r.fault_a for r in f.collect()} == {"ok": None, "mem": "swap_memory_diverged", "same": "swap_state_diverged", "two": "swap_state_diverged", "req": "swap_request_diverged", "half": "missing_branch"}


RECORD = "id string, category string, turns array<struct<role:string,text:string,think:string,calls:string,result:string>>, tools string, state string, memory string, pair_id string, branch string, request string, loaded_utc int, system_prompt string"


def record(i, category, state=None, pair=None, branch=None, think="a reason that is long enough", memory=None):
    turns = [("user", f" say {i} ", None, None, None), ("assistant", None, think, '[{"name":"f","arguments":{"n":1}}]', None)]
    return (i, category, turns, '[{"name":"f","parameters":["n"]}]', state, memory, pair, branch, "r", 1, "sys")


def test_shards_become_examples_by_two_roads(spark, rows):
    data = [record("u1", "x"), record("u2", "x", think="short"), record("u3", "x", state="{}"), record("q", "other"), record("n", None)]
    data += [record("pa", "p", '{"k":1}', "p1", "a", memory='{"recent":["m"]}'), record("pb", "p", '{"k":2}', "p1", "b", memory='{"recent":["m"]}'), record("sa", "p", '{"k":1}', "p2", "a"), record("sb", "p", '{"k":1}', "p2", "b"), record("ha", "p", '{"k":1}', "p3", "a")]
    good, bad = corpus.examples_of_shard(spark.createDataFrame(data, RECORD), {"x": False, "p": True}, (1, 3))
    assert {r.id: (r.example.user, r.example.memory) for r in good.collect()} == {"u1": ("say u1", None), "pa": ("say pa", " 1. m"), "pb": ("say pb", " 1. m")}
    assert {r.id: r.fault for r in bad.collect()} == {"u2": "empty_think", "u3": "state_unexpected", "q": "unknown_category", "n": "unknown_category", "sa": "swap_state_diverged", "sb": "swap_state_diverged", "ha": "missing_branch"}


def test_a_split_is_packed_and_written(spark, tmp_path):
    d = spark.createDataFrame([record(f"e{i}", "x", think="because " * (1 + i % 20)) for i in range(40)] + [record("long", "x", think="w " * 900)], RECORD)
    report, refused = corpus.pack_split(d, "val", 600, str(tmp_path))
    r, w = report.first(), spark.read.parquet(f"{tmp_path}/windows").collect()
    assert r["items"] == 40 and r.windows == len(w) and r.utilisation > 0.7 and [tuple(x) for x in refused.select("id", "drop_reason").collect()] == [("long", "too_long")]
    assert all(len(x.ids) == len(x["mask"]) == 600 and x.split == "val" for x in w)
    said = "".join(bytes(i for i, m in zip(x.ids, x["mask"]) if m).decode() for x in w)
    assert said.count("<think>because ") == 40 and "say e1" not in said
    with pytest.raises(ValueError, match="'test' has no windows"):
        corpus.pack_split(d.where("false"), "test", 600, str(tmp_path))


def test_evaluation_has_all_sections(spark):
    reply = "<think>use f because it fits</think><response>[{\"name\":\"%s\",\"arguments\":{}}]</response>"
    o = spark.createDataFrame([(i, reply % ("f" if i % 2 else "g"), '[{"name":"f","arguments":{}}]', "c", "s", f"g{i // 2}") for i in range(8)], "output_id bigint, response string, expected string, category string, subtype string, group_key string")
    kept = spark.createDataFrame([("c", "x", True), ("c", "x", False), ("c", "y", True)], "category string, fingerprint string, kept boolean")
    e = corpus.evaluation(o, o.select("category", "subtype"), spark.createDataFrame([("f",), ("g",)], "tool string"), kept)
    assert tuple(e["exact"].first()) == (8, 1.0, 0.5, 0.5, 4, 0, 0) and e["coupling"].first().decoupled == 4 and e["duplicates"].first().largest_cluster == 2
    assert {(r.want_name, r.got_name, r.n) for r in e["confusion"].collect()} == {("f", "f", 4), ("f", "g", 4)} and [tuple(r) for r in e["calls"].collect()] == [("g", 4, 1.0)]
    assert set(corpus.evaluation(o, o.select("category", "subtype"))) == {"rates", "faults", "pairs", "cells", "volume", "gap", "worst", "calls", "confusion", "exact"}
