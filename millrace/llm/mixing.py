"""Mixing sources to target weights (problem 1)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: Bits of the hash that one histogram resolves, of HASH_BITS in all; a source has 2 ** BITS cells at most.
BITS, HASH_BITS = 12, 60
#: A plan has one row per recipe and source; it is joined by broadcast up to this many rows, beyond by shuffle with each source in SALTS parts.
BROADCAST_ROWS, SALTS = 20_000, 64


def _zero() -> Column:
    return F.lit(0).cast("bigint")


class Mix:
    """Stages of a mix, each computed when it is first asked for."""

    def __init__(self, rows: DataFrame, config: DataFrame):
        self._source, self._config = rows, config

    @cached_property
    def _rows(self) -> DataFrame:
        """Source, key, size and hash of every record, without its text."""
        return materialise(self._source, "records")

    @cached_property
    def _level(self) -> DataFrame:
        return materialise(_histogram(self._rows, BITS), "histogram")

    @cached_property
    def asked(self) -> DataFrame:
        """A row per recipe and source with what its share asks for and whether it can be had; no threshold is sought for it."""
        total = self._level.agg(F.sum("size")).first()[0] or 0
        have = self._level.where("source_key is not null").groupBy("source_key").agg(F.sum("size").alias("available"), F.sum("records").alias("records"))
        c = self._config.where(F.col("config_id").isNotNull() & F.col("source_key").isNotNull()).groupBy("config_id", "source_key")
        c = c.agg(F.coalesce(F.sum("budget_tokens"), _zero()).alias("budget_tokens"), F.coalesce(F.max("xlam_epochs"), F.lit(0)).alias("xlam_epochs"), F.coalesce(F.max("mix_ratio"), F.lit(0.0)).alias("mix_ratio"))
        share = F.try_divide(F.col("budget_tokens").cast("double"), F.sum("budget_tokens").over(Window.partitionBy("config_id")))
        c = c.withColumn("target_share", F.coalesce(share, F.lit(0.0))).withColumn("target_size", F.col("target_share") * F.col("mix_ratio") * F.lit(float(total)))
        plan = c.join(have, "source_key", "left").fillna({"available": 0, "records": 0})
        plan = plan.withColumn("reachable", F.col("target_size") <= F.col("xlam_epochs") * F.col("available"))
        whole = F.least(F.coalesce(F.floor(F.try_divide("target_size", "available")), F.lit(0)), F.col("xlam_epochs"))
        plan = plan.withColumn("epochs", F.when(~F.col("reachable"), F.col("xlam_epochs")).otherwise(whole).cast("int"))
        rest = F.when(F.col("reachable"), F.col("target_size") - F.col("epochs") * F.col("available")).otherwise(0.0)
        return materialise(plan.withColumn("rest", rest), "asked")

    @cached_property
    def _bounds(self) -> DataFrame:
        """``config_id, source_key, below, extra``: the hash under which records are used once more, and their size."""
        state = self.asked.where("rest > 0").select("config_id", "source_key", "rest", _zero().alias("prefix"), _zero().alias("before"))
        done = state.select("config_id", "source_key", _zero().alias("below"), _zero().alias("extra")).where("false")
        cells = self._level.where("source_key is not null").withColumn("prefix", _zero())
        for bits in range(BITS, HASH_BITS + 1, BITS):
            if bits > BITS:  # refine the boundary cells only
                near = self._rows.withColumn("prefix", F.shiftright("h", HASH_BITS - bits + BITS)).join(state.select("source_key", "prefix").distinct(), ["source_key", "prefix"])
                cells = _histogram(near, bits, "prefix")
            w = Window.partitionBy("source_key", "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** BITS rows at most
            cells = cells.withColumn("sum", F.coalesce(F.sum("size").over(w), _zero()))
            start = F.col("before") + F.col("sum")
            hit = state.join(cells, ["source_key", "prefix"]).where((start <= F.col("rest")) & (F.col("rest") < start + F.col("size"))).select("config_id", "source_key", "cell", start.alias("start"), "size", "records")
            at = state.join(hit, ["config_id", "source_key"], "left")
            if bits < HASH_BITS:
                at = materialise(at, "boundary")
            end = F.shiftleft(F.col("prefix") + 1, HASH_BITS - bits + BITS)
            take = F.when(F.col("start") + F.col("size") - F.col("rest") < F.col("rest") - F.col("start"), 1).otherwise(0)  # the nearer of both
            settled = F.col("cell").isNull() | (F.col("records") == 1) | F.lit(bits >= HASH_BITS)
            below = F.when(F.col("cell").isNull(), end).otherwise(F.shiftleft(F.col("cell") + take, HASH_BITS - bits))  # without a hit rounding took the whole cell
            extra = F.when(F.col("cell").isNull(), F.col("before")).otherwise(F.col("start") + F.col("size") * take)
            done = done.unionByName(at.where(settled).select("config_id", "source_key", below.alias("below"), extra.alias("extra")))
            state = at.where(~settled).select("config_id", "source_key", "rest", F.col("cell").alias("prefix"), F.col("start").alias("before"))
            if bits < HASH_BITS and state.isEmpty():
                break
        return done

    @cached_property
    def _planned(self) -> DataFrame:
        p = self.asked.join(self._bounds, ["config_id", "source_key"], "left").fillna({"below": 0, "extra": 0})
        return materialise(p.withColumn("actual_size", F.col("epochs") * F.col("available") + F.col("extra")), "plan")

    @cached_property
    def plan(self) -> DataFrame:
        """A row per recipe and source: what its share asks for and what is reached."""
        share = F.try_divide(F.col("actual_size").cast("double"), F.sum("actual_size").over(Window.partitionBy("config_id")))
        missing = F.greatest(F.lit(0.0), F.col("target_size") - F.col("xlam_epochs") * F.col("available"))
        return self._planned.select("config_id", "source_key", "budget_tokens", "xlam_epochs", "records", "available", "target_share", "target_size", "epochs", "actual_size", F.coalesce(share, F.lit(0.0)).alias("actual_share"), missing.alias("missing_size"), "reachable")

    @cached_property
    def records(self) -> DataFrame:
        """A row per recipe and record with its number of copies."""
        cut, rows = self._planned.where("epochs > 0 or below > 0").select("config_id", "source_key", "epochs", "below"), self._rows
        if cut.count() <= BROADCAST_ROWS:
            d = rows.join(F.broadcast(cut), "source_key")
        else:
            cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            d = rows.withColumn("salt", (F.col("h") % SALTS).cast("int")).join(cut, ["source_key", "salt"])
        d = d.withColumn("copies", F.col("epochs") + (F.col("h") < F.col("below")).cast("int")).where("copies > 0")
        return d.select("config_id", "record_key", "source_key", "size", "copies")


def _histogram(rows: DataFrame, bits: int, *by: str) -> DataFrame:
    return rows.groupBy("source_key", *by, F.shiftright("h", HASH_BITS - bits).alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("records"))


def mix_sources(documents: DataFrame, config: DataFrame, source: Column, size: Column, key: Column, seed: int = 17) -> Mix:
    """Records of several sources, each source with its budget's share of a mix, none used more often than its cap.

    ``config`` has ``config_id, source_key, budget_tokens, xlam_epochs, mix_ratio``. The mix of a recipe is ``mix_ratio`` times
    the size of all records, also of those without a source, divided in proportion to the budgets. A source whose share is
    ``e`` times its own size plus a rest gives every record ``e`` times and, once more, those records whose hash lies under a
    threshold. One hash order serves all recipes, so their choices are nested. Thresholds come from histograms: sizes are
    summed by source and the first 12 bits of the hash, then only the cells that hold a boundary by the next 12 bits, until a
    cell holds one hash. Nothing is sorted and no row of plan or histogram reaches the driver. Of the two thresholds around a
    boundary record the one nearer to the share is taken, so a source misses its share by half a record's size at most.

    A share beyond ``xlam_epochs`` times the source is filled as far as it goes; ``reachable`` is false then. Null and negative
    sizes count as 0, a null source belongs to no recipe, records with equal keys are taken together, repeated rows count as
    often as they come, an empty table gives zero sizes. Rows of ``config`` with a null recipe or source ask for nothing, repeated
    ones of a recipe and source are one with the sum of the budgets.
    """
    rows = documents.select(source.alias("source_key"), key.alias("record_key"), F.greatest(F.coalesce(size.cast("bigint"), _zero()), _zero()).alias("size"))
    return Mix(rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("record_key", F.lit(seed)), 64 - HASH_BITS)), config)
