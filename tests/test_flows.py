"""Sources, sinks, streams, rendering, judges, and every query against its SQL on the smallest tables."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace import queries as core
from millrace.functions import render
from millrace.operators import judge, order
from millrace.sources import readers, sinks
from millrace.streaming import ingest

DATA = "/root/testdata/sf0.001"


def test_tolerant_json_lines(spark, tmp_path, rows):
    p = tmp_path / "s.jsonl"
    p.write_text('{"id":"a","decision":"a","more":1}\n\n{"id":"b","deci\n{"id":"c","decision":"what"}\n{"decision":"skip"}\n')
    assert rows(readers.json_lines(spark, str(p), "id string, decision string")) == [("a", "a"), ("c", "what"), (None, "skip")]
    assert rows(readers.completed_ids(readers.json_lines(spark, str(p), "id string"))) == [("a",), ("c",)]
    assert rows(readers.preferences(spark, str(p))) == [("a", None, "a"), (None, None, "skip")]


def test_scans(spark, tmp_path, rows):
    d = spark.createDataFrame([(1, "x", 4), (2, "", 5), (3, "y", None), (4, None, 5), (5, "z", 3)], "i int, text string, int_score int")
    assert rows(readers.tier_scan(d, 4).select("i")) == [(1,)] and readers.tier_scan(d, 0).count() == 3
    assert readers.epochs(d, 3).count() == 15 and readers.epochs(d, 0).count() == 0
    s = readers.Sources()
    s.add("web", lambda spark, folder: d)
    assert s.read("web", spark, "").count() == 5
    with pytest.raises(KeyError, match="web"):
        s.read("other", spark, "")
    assert readers.window_scan(spark.range(100), "id", 60, 1).count() == 40
    a, b = (readers.window_sample(x, "id", 10, 1).collect() for x in (spark.range(100), spark.range(100).repartition(5)))
    assert a == b
    got = readers.batches(spark.range(25), "id", 8).collect()
    assert sorted({r.batch_no for r in got}) == [0, 1, 2] and len(got) == 24
    w = spark.createDataFrame([([1, 2], [1, 0])], "ids array<int>, mask array<int>")
    assert readers.checked_windows(w).first()["labels"] == [1, -100]
    with pytest.raises(Exception, match="differ"):
        readers.checked_windows(spark.createDataFrame([([1, 2], [1])], "ids array<int>, mask array<int>")).collect()
    for n in (10, 20, 15):
        (tmp_path / f"step_{n}").mkdir()
        (tmp_path / f"step_{n}" / "state.json").write_text("{}")
    (tmp_path / "step_99").mkdir()
    assert readers.newest(readers.catalogue(spark, str(tmp_path))).first().step == 20


def test_driver_side_helpers(spark):
    from millrace.functions import text
    from millrace.operators import pack

    assert text.satisfies("1.10", ">=1.2,<2") and not text.satisfies("2.0.0", "<2") and text.satisfies("v3", "==3.0.0,!=3.1")
    with pytest.raises(ValueError):
        text.satisfies("1", "~1")
    assert [len(b) for b in readers.loader(spark.range(10), 4)] == [4, 4] and sum(len(b) for b in readers.loader(spark.range(10), 4, False)) == 10
    assert readers.config_differences({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 1.0, "c": 2}, "e": 1}) == ["a.b", "d", "e"]
    assert pack.steps(10, 3, 4) == 7 and pack.steps(0, 1, 4) == 1 and pack.missing_tokens({"<tool>": 0}, render.SPECIAL[:2]) == ["</tool>"] and len(render.SPECIAL) == 14


def test_probe_files(spark, tmp_path, rows):
    (tmp_path / "base_1.json").write_text(json.dumps({"outputs": [{"score": 3}, {"score": None}]}, indent=1))
    assert rows(readers.probe_files(spark, f"{tmp_path}/*.json", "score int")) == [("base_1", 0, 3), ("base_1", 1, None)]


def test_sinks(spark, tmp_path, rows):
    d = spark.range(10).withColumn("split", F.when(F.col("id") < 2, "val").otherwise("train"))
    assert sinks.write_verified(d, f"{tmp_path}/a", "id") == 10
    sinks.write_split(d, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/windows").where("split = 'val'").count() == 2
    with pytest.raises(ValueError):
        sinks.write_split(d.where("false"), f"{tmp_path}/none")
    for _ in range(2):
        sinks.append(d, f"{tmp_path}/log", "split")
    assert spark.read.json(f"{tmp_path}/log").count() == 20
    sinks.export(d, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["id", "split"]
    sinks.write_json({"a": 1}, f"{tmp_path}/x/y.json")
    assert readers.load_json(f"{tmp_path}/x/y.json", {"b"}) == {}
    t = lambda *x: spark.createDataFrame(list(x), "source string, tokens bigint")
    got = {r.source: r.status for r in sinks.integrity(t(("a", 1), ("b", 1), ("c", 1), ("d", 1)), t(("a", 1), ("b", 2), ("c", 1)), t(("a", 1), ("b", 2), ("c", 9))).collect()}
    assert got == {"a": "ok", "b": "manifest_differs", "c": "remote_differs", "d": "missing"}


def test_rendering(spark):
    turns = [("user", "hi", None, None, None), ("assistant", None, "why", "[]", None), ("tool", None, None, None, "{}")]
    d = spark.createDataFrame([("sys", "é", turns)], "s string, st string, turns array<struct<role:string,text:string,think:string,calls:string,result:string>>")
    p = render.segments(F.col("turns"), F.col("s"), F.col("st"))
    r = d.select(render.joined(p).alias("all"), render.prompt(p).alias("prompt"), render.labelled(p).alias("x")).first()
    assert r["all"].startswith(r["prompt"]) and r["prompt"].endswith("<|user|>\nhi\n") and "<state>é</state>" in r["prompt"]
    assert bytes(r["x"]["ids"]).decode() == r["all"]
    assert bytes(i for i in r["x"]["labels"] if i != -100).decode() == "<|assistant|>\n<think>why</think><response>[]</response>\n"
    one = spark.range(1)
    assert one.select(render.byte_tokens(F.lit("")), render.chat_document(F.lit(" "), F.lit("c")), render.chat_document(F.lit("s"), F.lit(" ")), render.memory_block(F.array(F.lit("a"), F.lit("b")))).first()[:] == ([], "c", None, " 1. a\n 2. b")
    assert one.select(render.preference(F.lit("b"), F.lit("x"), F.lit("y")).alias("p")).first().p[:] == ("y", "x")


def test_judges_fail_alone(spark, rows):
    g = spark.createDataFrame([(i, None if i < 8 else "no_think", i % 2 == 0, f"p{i}") for i in range(10)], "i int, fault string, correct boolean, prompt string")
    t = judge.targets(g, {"triage": (~F.col("correct"), 2)}, ["i"], {"all_right": F.col("correct")})
    assert rows(t.groupBy("dimension").count()) == [("all_right", 4), ("triage", 2)]
    assert rows(judge.calibration_targets(g, ["i"], 4).select("i")) == [(0,), (1,), (2,), (3,)]

    def ask(p):
        if p == "p3":
            raise RuntimeError
        return f"SCORE: {p[1]}"

    from millrace.functions import text

    got = {r.i: r.score for r in judge.ask_all(g, "prompt", ask, text.score(F.col("reply"))).collect()}
    assert got[3] is None and got[4] == 4 and len(got) == 10


def test_budgeted_ingest_resumes(spark, tmp_path):
    schema = "source string, pos bigint, n int"
    budgets = spark.createDataFrame([("a", 35), ("b", 100)], "source string, budget bigint")

    def more(lo, hi):
        spark.createDataFrame([(s, i, 10) for s in "ab" for i in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    for lo, hi in ((0, 2), (2, 4), (4, 6)):
        more(lo, hi)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.ingest(s, budgets, f"{tmp_path}/out", f"{tmp_path}/cp", "source", "pos", F.col("n")).awaitTermination()
    got = {r.source: r.t for r in spark.read.parquet(f"{tmp_path}/out").groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert got == {"a": 35, "b": 60}


def test_ingest_ends_when_what_was_taken_cannot_be_read(spark, tmp_path):
    """An unreadable file among the earlier batches is an error, not an empty start that would spend the budget twice."""
    budgets = spark.createDataFrame([("a", 35)], "source string, budget bigint")
    spark.createDataFrame([("a", 1, 10)], "source string, pos bigint, n int").write.parquet(f"{tmp_path}/in")
    (tmp_path / "out" / "batch_no=0").mkdir(parents=True)
    (tmp_path / "out" / "batch_no=0" / "part-0.parquet").write_text("no parquet")
    s = spark.readStream.schema("source string, pos bigint, n int").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception):
        ingest.ingest(s, budgets, f"{tmp_path}/out", f"{tmp_path}/cp", "source", "pos", F.col("n")).awaitTermination()


def run(stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_streams(spark, tmp_path, rows):
    at = dt.datetime(2030, 1, 1)
    data = [("r", i % 4, at + dt.timedelta(minutes=20 * i), float(i)) for i in range(12)]
    for i in range(0, 12, 4):
        spark.createDataFrame(data[i : i + 4], "run string, k int, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    s = spark.readStream.schema("run string, k int, ts timestamp, v double").parquet(f"{tmp_path}/s")
    run(ingest.unseen(s, "k"), "seen")
    assert spark.table("seen").count() == 4
    run(ingest.moving_average(s, "run", "ts", "v", 0.5), "avg")
    want = order.ema(spark.createDataFrame(data, "run string, k int, ts timestamp, v double"), "run", "ts", "v", 0.5)
    assert rows(spark.table("avg")) == rows(want.select("run", "ts", "v", "ema"))
    run(ingest.windowed(s, "ts", "1 hour", "10 minutes", ["run"], n=F.count(F.lit(1))), "win", "complete")
    assert [r.n for r in spark.table("win").orderBy("window_start").collect()] == [3, 3, 3, 3]


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return str([plain(y) for y in (x.tolist() if hasattr(x, "tolist") else x)]) if not isinstance(x, float) and hasattr(x, "__len__") else float("%.9g" % x)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float("%.9g" % x)
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = db.execute(core.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = core.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: repr(r)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
