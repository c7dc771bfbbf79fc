"""Sinks: verified tables, splits, append-only stores, exports, integrity of what was written."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.sources import files


@dataclass(frozen=True)
class Layout:
    """The one place that names a corpus's folders."""

    root: str

    def source(self, key: str) -> str:
        return f"{self.root}/sources/{key}"

    def shard(self, category: str) -> str:
        return f"{self.root}/raw/category={category}"

    @property
    def combined(self) -> str:
        return f"{self.root}/combined"

    def split(self, name: str) -> str:
        return f"{self.root}/windows/split={name}"

    @property
    def stats(self) -> str:
        return f"{self.root}/stats.json"


class ShortWrite(RuntimeError):
    """What was written is not what was meant."""


def write_verified(df: DataFrame, path: str, key_total: str | None = None, mode: str = "error") -> int:
    """Write a table through Spark's commit protocol and read it back: the number of rows, and the sum of a column, must be those written.

    ``df`` should be deterministic; it is counted while it is written, not computed twice. What comes back short is written once
    more, then it is an error.
    """
    try:
        return _write_once(df, path, key_total, mode)
    except ShortWrite:
        if mode == "append":
            raise
        return _write_once(df, path, key_total, "overwrite")


def _write_once(df: DataFrame, path: str, key_total: str | None, mode: str) -> int:
    observed = Observation()
    what = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key_total) if key_total else F.lit(0), F.lit(0)).cast("double").alias("s") if key_total else F.max(F.lit(0.0)).alias("s")]
    df.observe(observed, *what).write.mode(mode).parquet(path)
    back = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *( [F.coalesce(F.sum(key_total), F.lit(0)).cast("double").alias("s")] if key_total else [])).first()
    got = observed.get
    if mode in ("error", "errorifexists", "overwrite") and (back["n"] != got["n"] or key_total and abs(back["s"] - (got["s"] or 0)) > 1e-6 * max(1.0, abs(back["s"]))):
        raise ShortWrite(f"{path}: {back} read, {got} written")
    return back["n"]


def write_split(windows: DataFrame, root: str) -> None:
    """Windows by split; an empty split is an error."""
    if windows.isEmpty():
        raise ValueError("no windows to write")
    windows.write.partitionBy("split").parquet(f"{root}/windows")


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Add rows to a JSON store that is only ever added to."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one CSV (with names) or JSON file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def write_json(doc: dict, path: str) -> None:
    """A small document in the shared file system, replaced as a whole."""
    files.replace_text(path, json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True))


def restore_if_absent(remote: str, local: str) -> bool:
    """Copy a folder or file to where it is missing, verified. Whether it was copied; an error if both are missing."""
    if files.exists(local):
        return False
    if not files.exists(remote):
        raise FileNotFoundError(f"neither {local} nor {remote} is there")
    files.copy_whole(remote, local)
    return True


def write_diagnostics(report: dict[str, DataFrame], generations: DataFrame, root: str, most: int = 10_000) -> None:
    """Every generation as JSON lines under ``generations``, and the small tables of a report, at most ``most`` rows each, as one document."""
    generations.write.mode("overwrite").json(f"{root}/generations")
    tables = {}
    for name, df in report.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: it is no report")
        tables[name] = [r.asDict(recursive=True) for r in rows]
    lines = [json.dumps(tables, ensure_ascii=False, sort_keys=True, default=str)]
    generations.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/report")


def write_corpus(windows: DataFrame, slots: DataFrame, root: str, keys: list[str]) -> int:
    """Windows with their slot, in ranges of it, and a manifest beside them that is written last: a corpus without one is not finished. The number of windows' parts."""
    done = windows.join(slots, keys)
    n = write_verified(done.repartitionByRange("slot").sortWithinPartitions("slot"), f"{root}/combined")
    by = [k for k in keys if k != "window_id"]
    manifest = done.groupBy(*by).agg(F.countDistinct("window_id").alias("windows"), F.sum("taken").alias("tokens"))
    manifest.coalesce(1).write.mode("error").json(f"{root}/manifest")
    return n


def integrity(claimed: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """``source, claimed, local, remote, status``: what the manifest says against what is there. All three are ``source, tokens``."""
    d = claimed.select("source", F.col("tokens").alias("claimed"))
    for name, x in (("local", local), ("remote", remote)):
        d = d.join(x.select("source", F.col("tokens").alias(name)), "source", "full")
    status = F.when(F.col("local").isNull() & F.col("remote").isNull(), "missing").when(F.col("local").eqNullSafe(F.col("claimed")) & F.col("remote").eqNullSafe(F.col("claimed")), "ok").when(F.col("remote").eqNullSafe(F.col("local")), "manifest_differs").when(F.col("local").eqNullSafe(F.col("claimed")), "remote_differs").otherwise("local_differs")
    return d.withColumn("status", status)
