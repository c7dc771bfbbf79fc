import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx, names, stats, text


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_plain_names(spark):
    x = F.col("x")
    for raw, want in ((" Edu  Web ", "edu_web"), ("EDU-_web", "edu_web"), ("\tN/A", None), ("", None), ("-", None), ("none", None), (None, None)):
        assert one(spark, raw, names.key(x))[0] == want
    assert one(spark, "en-EN", names.lang(x)) == ("en",) and one(spark, "py", names.lang(x)) == ("python",) and one(spark, None, names.lang(x)) == (None,)


def test_between_takes_the_next_close(spark):
    x = F.col("x")
    assert one(spark, "a</think><think> b </think> c</think>", text.think(x)) == ("b",)
    for bad in ("<think>open", "no tags", "</think><think>", None):
        assert one(spark, bad, text.think(x)) == (None,)


def test_four_score_parsers(spark):
    x = F.col("x")
    modes = [text.score(x, m) for m in ("first_digit", "clamped", "rejected", "last_digit")]
    assert one(spark, "SCORE: 45", *modes) == (4, 5, -1, -1)
    assert one(spark, "the score is 3 of 5", *modes) == (None, -1, -1, -1)  # only what stands behind "SCORE:" counts
    assert one(spark, "score : 3", *modes) == (3, -1, -1, -1) and one(spark, "Score:\n2", *modes) == (2, 2, 2, 2)
    assert one(spark, "SCORE: 99999999999999999999", *modes)[1:3] == (5, -1)
    assert one(spark, "SCORE: 3</think> none here", *modes)[3] == 3
    assert one(spark, "REASON: short  \nSCORE: 3", text.score_reason(x)) == ("short",) and one(spark, "none", text.score_reason(x)) == (None,)
    assert one(spark, "nothing", *modes) == (None, -1, -1, -1)
    assert one(spark, "Score: 1 </think> Score: 2 Score: 4", *modes)[3] == 4
    with pytest.raises(ValueError):
        text.score(x, "other")


def test_small_text_functions(spark):
    x = F.col("x")
    assert one(spark, "b_12 and xb_3 b_4x", text.without_ids(x)) == ("<id> and xb_3 b_4x",)
    assert one(spark, "use a.b now", text.mentions(x, F.lit("a.b")), text.mentions(x, F.lit("axb"))) == (True, False)
    assert one(spark, "abcdef", text.shortened(x, 3)) == ("abc ...[truncated]",)
    assert one(spark, "go</response>x", text.until(x, "</response>", "<pad>")) == ("go",)
    assert one(spark, " \n short 　", text.think_fault(x), text.strip(x)) == ("empty_think", "short")
    assert one(spark, "a long enough < / think text", text.think_fault(x)) == ("think_leaked_markup",)
    assert one(spark, "v1.10.2", text.version_key(x) > F.array(*[F.lit(i) for i in (1, 9, 9, 0)])) == (True,)


def test_objects_in_free_text(spark):
    x = F.col("x")
    for raw, want in (('Here: ```{"a": "}{"}``` x', '{"a": "}{"}'), ('{"a": "\\""} {', '{"a": "\\""}'), ("{", None), ("", None), ("[1]", None), (None, None)):
        assert one(spark, raw, jsonx.extract_object(x)) == (want,)
    assert one(spark, 'call [{"name":"f"}] end', jsonx.first_calls(x)) == ('[{"name":"f"}]',)
    assert one(spark, "[1]", jsonx.first_calls(x)) == (None,)


def test_calls_are_equal_by_value(spark):
    x = F.col("x")
    canon = lambda s: one(spark, s, jsonx.canonical_calls(x))[0]
    assert canon('[{"name":"f","arguments":{"a":500,"b":" x "}}]') == canon('{"arguments":{"b":"x","a":500.0},"name":"f"}')
    assert canon('[{"name":"f","arguments":{"a":true}}]') != canon('[{"name":"f","arguments":{"a":1}}]')
    assert canon('[{"name":"answer","arguments":{"text":"p"}}]') == canon('[{"name":"answer","arguments":{"text":"q"}}]')
    assert canon("[1]") is None and canon(None) is None and canon("[]") == []
    assert one(spark, '[{"name":"f","arguments":{"a":500}}]', jsonx.lexical_calls(x)) != one(spark, '[{"name":"f","arguments":{"a":500.0}}]', jsonx.lexical_calls(x))


def test_call_faults(spark):
    tools = json.dumps([{"name": "f", "parameters": {"properties": {"n": {"type": "integer"}, "x": {"type": "number"}}, "required": ["n"]}}])
    for calls, want in (([{"name": "f", "arguments": {"n": 1, "x": 2}}], None), ([{"name": "f", "arguments": {"n": True}}], "bad_arg_type"), ([{"name": "f", "arguments": {"n": 1.0}}], "bad_arg_type"), ([{"name": "f", "arguments": {}}], "missing_required_arg"), ([{"name": "f", "arguments": {"n": 1, "z": 1}}], "unknown_arg"), ([{"name": "g"}], "undefined_tool"), ([{"x": 1}], "bad_shape"), ([], "empty_calls"), (3, "no_response")):
        assert one(spark, json.dumps(calls), jsonx.calls_fault(F.col("x"), F.lit(tools))) == (want,)


def test_pointers(spark):
    doc = json.dumps({"b": [{"id": 1, "off": None}], "a/b": {"~": 2}})
    x = F.col("x")
    get = lambda p: one(spark, doc, jsonx.pointer_get(x, F.lit(p)), jsonx.pointer_exists(x, F.lit(p)))
    assert get("/b/0/id") == ("1", True) and get("/b/0/off") == ("null", True) and get("/b/1") == (None, False) and get("/a~1b/~0") == ("2", True) and get("b") == (None, False)
    assert all(get(f"/b/{t}") == (None, False) for t in ("²", "--1", "-1", "+0", "٣", "0x0", "9" * 30, ""))
    put = lambda p: one(spark, doc, jsonx.pointer_put(x, F.lit(p), F.lit("false")))[0]
    assert json.loads(put("/b/0/off"))["b"][0]["off"] is False and put("/b/0/new") is None and put("") is None
    assert one(spark, '{"a":[1,2],"b":true,"c":{"d":1}}', jsonx.diff_paths(x, F.lit('{"a":[1],"b":1,"c":{"d":1,"e":2}}'))) == (["/a", "/b", "/c/e"],)
    assert one(spark, '{"a":[{"x":1},{"y":2}],"b":{}}', jsonx.leaf_paths(x)) == (["/a/#/x", "/a/#/y", "/b"],)


def test_batch_seed_is_the_pinned_one(spark):
    ids = F.array(*[F.lit(f"single_stage-{i:06d}") for i in range(4)])
    assert spark.range(1).select(jsonx.batch_seed(ids, F.lit(20240201))).first()[0] == 1_199_924_749


def test_statistics(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 20.0), (2, 15.0), (4, 40.0), (None, 1.0)], "x int, y double")
    assert abs(stats.spearman(d, "x", "y").first().rho - 0.9486832980505138) < 1e-12
    assert stats.spearman(d.limit(2), "x", "y").first().rho is None
    flat = spark.createDataFrame([(i, 1.0) for i in range(6)], "x int, y double")
    assert stats.spearman(flat, "x", "y").first().rho == 0.0
    assert d.agg(stats.upper_median(F.col("y"))).first()[0] == 15.0 and d.where("x = 2").agg(stats.upper_median(F.col("y"))).first()[0] == 20.0
    lr = [r[0] for r in spark.range(12).orderBy("id").select(stats.warm_cosine(F.col("id"), 10, 2, 1.0, 0.1)).collect()]
    assert lr[0] == 0.5 and lr[1] == 1.0 and abs(lr[6] - 0.55) < 1e-12 and abs(lr[11] - 0.1) < 1e-12
    low, high = spark.range(1).select(stats.wilson(F.lit(4), F.lit(44)).alias("w")).select("w.*").first()
    assert abs(low - 0.036) < 1e-3 and abs(high - 0.212) < 1e-3
    assert tuple(spark.range(1).select(stats.wilson(F.lit(0), F.lit(0)).alias("w")).select("w.*").first()) == (0.0, 0.0)
    assert spark.range(1).select(stats.perplexity(F.lit(99.0))).first()[0] == math.exp(30)
