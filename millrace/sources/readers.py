"""Scans: corpora by tier, repeated and joined sources, tolerant JSON lines, windows, catalogues."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.order import hash_rank
from millrace.sources import files


def tier_scan(documents: DataFrame, least: int, tier: str = "int_score", text: str = "text") -> DataFrame:
    """Rows of at least tier ``least`` with a text. A null tier is below all positive ones; the comparison reaches the Parquet scan."""
    if least <= 0:
        return documents.where(F.length(text) > 0)
    return documents.where((F.col(tier) >= least) & (F.length(text) > 0))


def shuffled(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    """Rows in an order that depends on their key alone, sorted in ranges by many tasks."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """Rows ``n`` times, with ``epoch``: a generator, not a join."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else rows.withColumn("epoch", F.lit(0)).where("false")


def in_sequence(*parts: DataFrame) -> DataFrame:
    """Parts one after the other, ``part_no`` keeping their order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """A table with a folder for every value of ``by``, rows of a value in several files where they are many."""
    rows.repartition(by, F.pmod(F.xxhash64(*[c for c in rows.columns if c != by]), F.lit(8))).write.partitionBy(by).parquet(path)


def partition_scan(spark: SparkSession, path: str, by: str, values: list[str]) -> DataFrame:
    """Rows of some values of a partitioned table; folders of others are not read."""
    return spark.read.parquet(path).where(F.col(by).isin(*values))


class Sources:
    """Named readers; an unknown name is an error that lists the known ones."""

    def __init__(self):
        self._readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def add(self, name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        self._readers[name] = reader

    def read(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"unknown source {name!r}: one of {', '.join(sorted(self._readers))}")
        return self._readers[name](spark, folder)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are whole JSON objects; blank and torn ones are skipped, unknown fields ignored, missing ones null."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r")).select("r.*")
    return parsed.where("__broken is null").drop("__broken")


def completed_ids(shard: DataFrame, key: str = "id") -> DataFrame:
    """The ids that a shard already has."""
    return shard.where(F.col(key).isNotNull()).select(key).distinct()


def unfinished(requests: DataFrame, shard: DataFrame, key: str = "id") -> DataFrame:
    """Requests without a row in the shard."""
    return requests.join(completed_ids(shard, key), key, "left_anti")


#: Decisions of a preference record. Fixed values.
DECISIONS = ("a", "b", "both_good", "both_bad", "skip")


def preferences(spark: SparkSession, path: str, schema: str = "id string, category string, decision string") -> DataFrame:
    """Preference records with a known decision."""
    return json_lines(spark, path, schema).where(F.col("decision").isin(*DECISIONS))


def probe_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per output of result files, ``label`` from the file's name without its ending."""
    d = spark.read.schema(f"outputs array<struct<{schema}>>").option("multiLine", True).json(glob)
    d = d.withColumn("label", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return d.select("label", F.posexplode("outputs").alias("item", "o")).select("label", "item", "o.*")


def catalogue(spark: SparkSession, folder: str, needs: str = "state.json") -> DataFrame:
    """``path, step`` of complete checkpoint folders "step_N"; the newest is the one with the greatest step."""
    named = [(p, p.rsplit("_", 1)[1]) for p in files.folders(f"{folder}/step_*")]
    found = [(p, int(n)) for p, n in named if n.isascii() and n.isdigit() and files.exists(f"{p}/{needs}")]
    return spark.createDataFrame(found, "path string, step bigint")


def load_json(path: str, known: set[str] | None = None) -> dict:
    """A JSON document of the shared file system; keys that aren't known are left out."""
    doc = json.loads(files.read_text(path))
    return doc if known is None else {k: v for k, v in doc.items() if k in known}


def window_scan(windows: DataFrame, key: str, start: int, seed: int) -> DataFrame:
    """Windows in a hash order from place ``start`` on, ``place`` numbered without a global sort."""
    return hash_rank(windows, [F.col(key)], "place", seed=seed).where(F.col("place") >= start)


def window_sample(windows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` windows by hash, the same however they are stored."""
    return windows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def batches(rows: DataFrame, order: str, size: int, most: int | None = None) -> DataFrame:
    """Rows in order in whole batches of ``size``: ``batch_no``; an incomplete last batch is left out."""
    from millrace.operators.order import prefix_sum

    d = prefix_sum(rows, None, order, F.lit(1), "__at").withColumn("batch_no", F.floor(F.col("__at") / size))
    whole = d.groupBy("batch_no").count().where(F.col("count") == size).select("batch_no")
    if most is not None:
        whole = whole.where(F.col("batch_no") < most)
    return d.join(whole, "batch_no").drop("__at")


def checked_windows(windows: DataFrame, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Windows with their labels: ids where the mask is 1, else -100; arrays of different lengths are an error when read."""
    same = F.size(ids) == F.size(mask)
    label = F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(-100))
    return windows.withColumn("labels", F.when(same, label).otherwise(F.raise_error(F.lit("ids and mask differ in length")).cast("array<int>")))


def worker_shard(rows: DataFrame, place: str, workers: int, worker: int) -> DataFrame:
    """Every ``workers``-th row, for one worker."""
    return rows.where(F.pmod(F.col(place), F.lit(workers)) == worker)


def newest(catalogue: DataFrame) -> DataFrame:
    """The newest checkpoint."""
    return catalogue.agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of every key."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.xxhash64(*rows.columns))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def loader(rows: DataFrame, size: int, drop_last: bool = True) -> Iterator[list[Row]]:
    """Batches of rows for a program on the driver, one partition ahead of it; nothing is held but the batch and a partition."""
    batch: list[Row] = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        batch.append(r)
        if len(batch) == size:
            yield batch
            batch = []
    if batch and not drop_last:
        yield batch


def config_differences(a: dict, b: dict, prefix: str = "") -> list[str]:
    """Paths of the leaves in which two configurations differ. For the driver; ``jsonx.diff_paths`` does it for columns."""
    out = []
    for k in sorted(a.keys() | b.keys()):
        x, y, path = a.get(k, ...), b.get(k, ...), f"{prefix}.{k}" if prefix else k
        if isinstance(x, dict) and isinstance(y, dict):
            out += config_differences(x, y, path)
        elif type(x) is not type(y) or x != y:
            out.append(path)
    return out
