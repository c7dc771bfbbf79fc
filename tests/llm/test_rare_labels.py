import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import splits


def split(spark, data, of):
    d = spark.createDataFrame(data, "i bigint, g string, c string")
    return splits.split_records(d, spark.createDataFrame(list(of.items()), "split_name string, fraction double"), F.col("i"), [F.col("g")], F.col("c"))


@pytest.mark.parametrize("head", [5, 200, 5_000])
def test_rare_labels_are_spread_over_all_splits_however_entities_are_placed(spark, monkeypatch, head):
    """The same method with few and with all entities placed one by one."""
    monkeypatch.setattr(splits, "HEAD", head)
    of = {"test": 0.05, "train": 0.9, "validation": 0.05}
    data = [(i, None if i % 3 else f"g{i // 9}", "rare" if i % 50 == 1 else "few" if i % 21 == 4 else "all") for i in range(6000)]
    n = {x: sum(c == x for _, _, c in data) for x in ("rare", "few", "all")}
    s = split(spark, data, of)
    report = s.report.collect()
    assert len(report) == 9 and s.records.count() == 6000
    for r in report:
        assert abs(r.records - of[r.split_name] * n[r.label]) <= 3.0, r
    at = {r.record_id: r.split_name for r in s.records.collect()}
    for g in range(700):
        assert len({at[i] for i, x, _ in data if x == f"g{g}"}) <= 1
    assert {tuple(r) for r in s.records.collect()} == {tuple(r) for r in split(spark, data[::-1], of).records.collect()}


def test_many_labels_of_a_few_records_do_not_all_go_to_one_split(spark, monkeypatch):
    monkeypatch.setattr(splits, "HEAD", 10)
    data = [(i, None, f"c{i // 3}") for i in range(900)]
    got = split(spark, data, {"a": 0.9, "b": 0.1}).records.groupBy("split_name").count().collect()
    assert abs({r.split_name: r["count"] for r in got}["b"] - 90) <= 2


def test_boundaries_carry_their_rounding_on():
    carry = np.zeros(2)
    ends = [splits.boundaries(np.array([0.9, 0.1]), 1.0, carry)[0] for _ in range(100)]
    assert sum(ends) == 90 and set(ends) <= {0.0, 1.0}
    assert splits.boundaries(np.array([-1.0, 0.0]), 5.0, np.zeros(2)).tolist() == [0.0, 5.0]


def test_rare_labels_reach_every_split(spark, monkeypatch):
    monkeypatch.setattr(splits, "HEAD", 10)
    data = [(i, None, "common" if i % 20 else "rare") for i in range(1600)]
    data += [(10_000 + 2 * i + k, f"g{i}", "pair") for i in range(40) for k in range(2)]  # a label of entities with two records
    data += [(20_000 + 2 * i + k, f"h{i}", ("common", "mixed")[k]) for i in range(60) for k in range(2)]
    fractions = {"train": 0.9, "validation": 0.05, "test": 0.05}
    d = spark.createDataFrame(data, "output_id bigint, g string, category string")
    s = splits.split_records(d, spark.createDataFrame(list(fractions.items()), "split_name string, fraction double"), F.col("output_id"), [F.col("g")], F.col("category"))
    got = collections.Counter((r.label, r.split_name) for r in s.records.collect())
    of = collections.Counter(c for _, _, c in data)
    assert sum(got.values()) == len(data)
    for label, n in of.items():
        for name, f in fractions.items():
            assert abs(got[label, name] - f * n) <= max(2, 0.01 * n), (label, name, got)
