"""Every query of the subpackage against its SQL on small tables; what has no SQL is a part of a query that has."""

import os

import duckdb
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x != x:
        return None
    return float("%.9g" % x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    a, b = (sorted((tuple(plain(v) for v in r) for r in x), key=repr) for x in (got.select(*columns).collect(), want.fetchall()))
    assert a == b and a


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_reports_agree_with_what_they_report(spark):
    run = lambda name: queries.queries()[name](spark, DATA).toPandas()
    mix, shares = run("p1_mix"), run("p1_shares")
    used = (mix["size"] * mix.copies).groupby([mix.config_id, mix.source_key]).sum()
    assert used.to_dict() == shares[shares.actual_size > 0].set_index(["config_id", "source_key"]).actual_size.to_dict()
    split, balance = run("p2_splits"), run("p2_balance")
    assert split.groupby(["split_name", "category"]).size().to_dict() == balance[balance.records > 0].set_index(["split_name", "label"]).records.to_dict()
    totals, cover = run("p3_token_totals"), run("p3_budget_cover")
    assert cover.groupby("source_key").tokens.first().to_dict().items() <= {**{k: 0 for k in cover.source_key}, **totals.groupby("source").tokens.sum().to_dict()}.items()
    margins, drawn = run("p5_margins"), run("p5_margin_sample")
    n = drawn.groupby("plan_id").size()
    assert (n - margins[margins.dimension == "category"].groupby("plan_id").expected.sum()).abs().max() <= 1
    items, report = run("p6_containers"), run("p6_report")
    assert items[items.container_id != "empty"].groupby("limit_id").container_id.nunique().to_dict() == report.set_index("limit_id").containers.to_dict()
    pieces, found = run("p8_pieces"), run("p8_found")
    assert set(zip(pieces.limit_id, pieces.doc_id)) == set(zip(found.limit_id, found.doc_id))
