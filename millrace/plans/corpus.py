"""Whole flows: a pretraining corpus, a set of training windows, an evaluation. Each stage is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import jsonx, render, text
from millrace.operators import dedup, diagnose, mixture, order, pack, pairs, split, validate
from millrace.sources import readers, sinks
from millrace.workspace import materialise


@dataclass(frozen=True)
class CorpusConfig:
    """Parameters of a pretraining corpus."""

    ctx: int = 4096
    least_tier: int = 4
    mode: str = "cap_proportional"
    seed: int = 0


@dataclass
class Corpus:
    allocation: DataFrame
    windows: DataFrame
    slots: DataFrame


def recipe_budgets(documents: DataFrame, config: DataFrame) -> DataFrame:
    """``config_id, source, budget, epochs`` of every recipe: its mix is ``mix_ratio`` times the size of all ``documents``, also of those without a source, divided in proportion to ``budget_tokens``.

    Sizes are bytes of ``text``, the tokens in which the flow cuts windows. Rows of ``config`` with a null key are left out; a null budget, ratio or cap asks for nothing.
    """
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("__total"))
    c = config.where("config_id is not null and source_key is not null").withColumn("__b", F.coalesce("budget_tokens", F.lit(0)))
    share = F.try_divide(F.col("__b").cast("double"), F.sum("__b").over(Window.partitionBy("config_id")))
    budget = F.floor(F.coalesce(share * F.col("mix_ratio") * F.col("__total"), F.lit(0.0))).cast("bigint")
    return c.crossJoin(F.broadcast(total)).select("config_id", F.col("source_key").alias("source"), budget.alias("budget"), F.coalesce("xlam_epochs", F.lit(0)).alias("epochs"))


def pretraining(documents: DataFrame, budgets: DataFrame, cfg: CorpusConfig) -> Corpus:
    """Documents ``source, doc_id, text, int_score`` in order to each source's budget, cut into windows, windows in a mixed order.

    ``budgets`` is ``config_id, source, budget, epochs`` in tokens of the byte tokenizer; it has a row per recipe and source, each
    recipe is a corpus of its own. A source whose budget is larger than its documents is gone through up to ``epochs`` times.
    """
    d = readers.tier_scan(documents, cfg.least_tier)  # a null tier is below all
    d = d.select("source", "doc_id", F.octet_length("text").cast("bigint").alias("__n"))
    have = d.groupBy("source").agg(F.sum("__n").alias("have"))
    plan = budgets.join(have, "source", "left").withColumn("actual", F.col("have") * F.col("epochs"))
    allocation = mixture.allocate(plan, cfg.ctx, cfg.mode, by=("config_id",))
    take = F.broadcast(allocation.where("take > 0").select("config_id", "source", "take").join(F.broadcast(have), "source"))
    # A document's place in a round through its source is the same for every recipe, so it is found once.
    used = order.prefix_sum(d, ["source"], "doc_id", F.col("__n"), "__first").join(take, "source")
    used = used.where("__first < take").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("take") - 1 - F.col("__first")) / F.col("have")))))
    used = used.withColumn("__at", F.col("epoch") * F.col("have") + F.col("__first")).withColumn("__n", F.least("__n", F.col("take") - F.col("__at")))
    windows = order.cut_at(used.select("config_id", "source", "epoch", "doc_id", F.col("__n").alias("used"), "__at", "__n"), cfg.ctx).drop("__at", "__n")
    slots = mixture.interleave(allocation.select("config_id", "source", (F.col("take") / cfg.ctx).cast("bigint").alias("windows")), cfg.seed, by=("config_id",))
    return Corpus(allocation, windows, slots)


@dataclass
class Training:
    examples: DataFrame
    dropped: DataFrame
    packed: DataFrame


def training(examples: DataFrame, group: str, ctx: int, fraction: float = 0.05, seed: int = 0) -> Training:
    """Examples validated, near-duplicates dropped with their groups, split, rendered to bytes and packed by split."""
    e = examples.withColumn("ok", validate.well_ordered(F.col("turns")))
    fp = F.array_join(F.transform("turns", lambda t: F.coalesce(text.without_ids(t["text"]), t["calls"], F.lit(""))), "\n")
    good = e.where("ok").withColumn("fp", fp)
    kept = dedup.dedup_groups(good.select("id", F.col(group).alias("g"), "fp"), "g", "id", "fp").where("kept").select("id")
    rest = good.join(kept, "id", "left_semi")
    parts = render.segments(F.col("turns"), F.col("system_prompt"), F.col("state"))
    sized = rest.select("id", F.col(group).alias("g"), F.octet_length(render.joined(parts)).cast("bigint").alias("n"))
    sized = validate.length_band(sized, "n", 1, ctx)
    dropped = sized.where("drop_reason is not null").groupBy("drop_reason").count()
    done = split.validation_split(sized.where("drop_reason is null"), F.coalesce("g", "id"), fraction, seed)
    packed = None
    for s in ("train", "val"):
        p = pack.bin_pack(done.where(F.col("split") == s), "id", "n", ctx, seed).withColumn("split", F.lit(s))
        packed = p if packed is None else packed.unionByName(p)
    return Training(done.select("id", "g", "n", "split"), dropped, packed)


def examples_of_shard(records: DataFrame, paired: dict[str, bool], bounds: tuple[int, int], order: str = "loaded_utc") -> tuple[DataFrame, DataFrame]:
    """``examples`` and ``refused`` (id, category, fault) of a shard of records, by two roads.

    ``records``: ``id, category, turns, tools, state, memory``, for pairs also ``pair_id, branch, request``. Records of an unpaired category are
    checked one by one; branches of a paired one together, both or neither being an example. Categories that ``paired``
    doesn't know are refused.
    """
    known = F.col("category").isin(list(paired))
    is_paired = F.col("category").isin([c for c, p in paired.items() if p])
    alone = records.where(known & ~is_paired)
    alone = validate.with_record_fault(alone, "fault", turns=F.col("turns"), tools=F.col("tools"), state=F.col("state"), memory=F.col("memory"), bounds=tuple(F.lit(b) for b in bounds), final_answer=F.lit(False), needs_state=F.lit(False), needs_memory=F.lit(False))
    p = pairs.pivot_pairs(records.where(is_paired), "pair_id", "branch", order, ["id", "category", "turns", "tools", "state", "memory", "request"])
    own = {x: F.when(~F.coalesce(validate.well_ordered(F.col(f"{x}.turns")), F.lit(False)), "bad_turn_order") for x in "ab"}
    both = pairs.pair_faults(p, pairs.swap_checks(), own)
    each = F.explode(F.array(*[F.struct(F.col(x).alias("r"), F.col(f"fault_{x}").alias("fault")) for x in "ab"]))
    both = both.select(each.alias("e")).where("e.r is not null").select("e.r.*", "e.fault")
    columns = ["id", "category", "turns", "tools", "state", "memory", "fault"]
    checked = alone.select(columns).unionByName(both.select(columns))
    unknown = records.where(~F.coalesce(known, F.lit(False))).select("id", "category", F.lit("unknown_category").alias("fault"))
    good = checked.where("fault is null")
    examples = good.select("id", "category", render.record_example(F.col("turns"), F.col("memory")).alias("example"), "turns", "state")
    return examples, checked.where("fault is not null").select("id", "category", "fault").unionByName(unknown)


def pack_split(examples: DataFrame, split: str, ctx: int, root: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A split's examples ``id, turns, system_prompt, state`` encoded, packed, laid out and written under ``root``: ``report`` and ``refused``. An empty split is an error."""
    coded = render.labelled(render.segments(F.col("turns"), F.col("system_prompt"), F.col("state")))
    items = examples.select("id", coded.alias("c")).select("id", F.col("c.ids").alias("ids"), F.transform("c.labels", lambda x: (x != render.IGNORE).cast("tinyint")).alias("mask"), F.size("c.ids").cast("bigint").alias("n"))
    packed = materialise(pack.bin_pack(items.select("id", "n"), "id", "n", ctx, seed), "packed")
    if packed.isEmpty():
        raise ValueError(f"split {split!r} has no windows")
    windows = pack.lay_out(packed.join(items.drop("n"), "id"), "ids", "mask", ctx, render.PAD)
    sinks.write_verified(windows, f"{root}/windows/split={split}")
    return pack.pack_stats(packed, "n", ctx).withColumn("split", F.lit(split)), pack.refused(items, "id", "n", ctx)


def evaluation(outputs: DataFrame, train: DataFrame, tools: DataFrame | None = None, kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """The reports on graded replies: ``outputs`` has ``output_id, response, expected, category, subtype, group_key``, ``train`` the cells.

    With ``tools``, names in a column ``tool``, reasoning is set against calls; with ``kept`` (``category, fingerprint, kept``) there is a section
    on duplicates of the corpus.
    """
    g = validate.graded(outputs, "response", "expected")
    reply = text.response(F.col("response"))
    first = lambda c: F.get(c, F.lit(0))
    calls = g.withColumns({"want_name": first(jsonx.call_names("expected")), "got_name": first(jsonx.call_names(reply)), "want": first(jsonx.canonical_calls("expected")), "got": first(jsonx.canonical_calls(reply))})
    cells = diagnose.cell_report(train, g, g.where("false"), ["category", "subtype"])
    out = {"rates": diagnose.rates(g, "category"), "faults": validate.tally(g, "fault", "output_id"), "pairs": pairs.outcomes(g, "group_key"), "cells": cells, "volume": diagnose.volume_correlation(cells), "gap": diagnose.memorisation_gap(cells)}
    out |= {"worst": diagnose.worst_cells(cells, ["category", "subtype"]), "calls": diagnose.default_call(calls, "got_name", "output_id"), "confusion": diagnose.confusion(calls, "want_name", "got_name", "output_id"), "exact": diagnose.exact_metrics(calls, "got", "want", "got_name", "want_name", "group_key")}
    if tools is not None:
        offered = F.broadcast(tools.agg(F.collect_set("tool").alias("offered")))  # names of tools, a small table
        out["coupling"] = diagnose.coupling(calls.where("fault is null").crossJoin(offered), text.think(F.col("response")), F.col("offered"), F.col("got_name"))
    if kept is not None:
        out["duplicates"] = diagnose.dedup_forensics(kept, ["category"], F.col("fingerprint"), F.col("kept"))
    return out
