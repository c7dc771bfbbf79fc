"""Checks of multi-turn records: the first fault of each, and tallies of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import jsonx, text


def assistant_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "assistant")


def well_ordered(turns: Column) -> Column:
    """Whether assistant turns come first and last and alternate with tool turns; a user turn before them is skipped."""
    rest = F.filter(turns, lambda t: F.coalesce(t["role"], F.lit("")) != "user")
    fits = F.forall(F.transform(rest, lambda t, i: t["role"].eqNullSafe(F.when(i % 2 == 0, "assistant").otherwise("tool"))), lambda ok: ok)
    return (F.size(rest) % 2 == 1) & fits


def first_fault(*checks: tuple[Column, str]) -> Column:
    """The name of the first check, in order, whose condition is true; null if none is."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in checks])


def record_fault(turns: Column, tools: Column | None, state: Column, memory: Column, bounds: tuple[Column, Column], final_answer: Column, needs_state: Column, needs_memory: Column) -> tuple[Column, Column]:
    """The first fault of a record, and the fault inside a turn that the mark ``__turn`` stands for, in the order: turns, number of turns, each turn's reasoning and calls, last call, state, memory.

    Turns are looked at one after the other, each one's reasoning before its calls, and each call against the tools offered: its
    shape, its name, its arguments. The earliest fault counts, whatever its kind. Without ``tools`` calls only have to be there.
    """
    said = assistant_turns(turns)
    reasoning = F.transform(said, lambda t: text.think_fault(F.coalesce(t["think"], F.lit(""))))
    if tools is None:
        calls = F.transform(said, lambda t: F.when(t["calls"].isNull(), "no_calls"))
    else:
        found = jsonx.turn_faults(F.transform(said, lambda t: t["calls"]), tools)
        calls = F.transform(found, lambda f: F.when(f.isin("no_response", "empty_calls"), "no_calls").otherwise(f))
    per_turn = F.zip_with(reasoning, calls, lambda a, b: F.coalesce(a, b))
    early = F.get(F.filter(per_turn, lambda x: x.isNotNull()), F.lit(0))
    last = F.try_element_at(said, F.lit(-1))["calls"]
    ends = F.size(F.from_json(last, "array<struct<name:string>>")) != 1
    name = F.get(F.from_json(last, "array<struct<name:string>>"), F.lit(0))["name"]
    populated = F.coalesce(F.size(F.from_json(memory, "struct<recent:array<string>,last_results:array<string>>")["recent"]) > 0, F.lit(False)) | F.coalesce(F.size(F.from_json(memory, "struct<recent:array<string>,last_results:array<string>>")["last_results"]) > 0, F.lit(False))
    n = F.size(said)
    return first_fault(
        (turns.isNull() | ~well_ordered(turns), "bad_turn_order"),
        (~n.between(*bounds), "turn_count_out_of_bounds"),
        (F.size(F.filter(per_turn, lambda x: x.isNotNull())) > 0, "__turn"),
        (final_answer & (ends | (name != "answer")), "final_call_not_answer"),
        (needs_state & state.isNull(), "state_missing"),
        (~needs_state & state.isNotNull(), "state_unexpected"),
        (needs_memory & ~populated, "memory_missing"),
        (~needs_memory & populated, "memory_unexpected"),
    ), early


def refuse_paired(specs: dict[str, bool], category: str) -> None:
    """An error for a paired category: its records are accepted or refused in pairs, by ``pairs.pair_faults``, never one by one. ``specs``: whether a category is paired."""
    if category not in specs:
        raise KeyError(f"unknown category {category!r}: one of {', '.join(sorted(specs))}")
    if specs[category]:
        raise ValueError(f"category {category!r} is paired: its branches are judged together")


def with_record_fault(df: DataFrame, out: str, **columns) -> DataFrame:
    """``record_fault`` as a column: the fault inside a turn takes the place of its mark."""
    fault, early = record_fault(**columns)
    return df.withColumn("__f", fault).withColumn("__e", early).withColumn(out, F.when(F.col("__f") == "__turn", F.col("__e")).otherwise(F.col("__f"))).drop("__f", "__e")


def generation_fault(reply: Column, tools: Column) -> Column:
    """The first fault of a generation from outside in: reasoning, call list, each call."""
    body = text.think(reply)
    return F.coalesce(F.when(body.isNull(), "no_think"), F.when(F.length(body) < text.MIN_THINK_CHARS, "short_think"), jsonx.calls_fault(text.response(reply), tools))


def graded(df: DataFrame, reply: str, expected: str, tools: Column | None = None) -> DataFrame:
    """``df`` with ``fault`` and ``correct``: the first call of a well-formed reply equals the first expected one, prose arguments aside.

    Without ``tools`` calls are only checked for their shape.
    """
    body = text.think(F.col(reply))
    calls = text.response(F.col(reply))
    names = jsonx.call_names(calls)
    shape = jsonx.calls_fault(calls, tools) if tools is not None else F.when(names.isNull(), "no_response").when(F.size(names) == 0, "empty_calls").when(F.array_contains(names, "None"), "bad_shape")
    d = df.withColumn("fault", F.coalesce(F.when(body.isNull(), "no_think"), F.when(F.length(body) < text.MIN_THINK_CHARS, "short_think"), shape))
    got, want = F.get(jsonx.canonical_calls(calls), F.lit(0)), F.get(jsonx.canonical_calls(F.col(expected)), F.lit(0))
    return d.withColumn("correct", F.col("fault").isNull() & F.coalesce(got == want, F.lit(False)))


def tally(df: DataFrame, fault: str, order: str, by: list[str] | None = None) -> DataFrame:
    """``by..., fault, n, share`` by falling ``n``, ties by first occurrence; a null fault is an accepted row. One aggregation for all groups and the whole."""
    keys = by or []
    g = df.groupBy(*keys, fault).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("share", F.col("n") / F.sum("n").over(w))
    return g.orderBy(*keys, F.desc("n"), "__first").drop("__first")


def length_band(df: DataFrame, tokens: str, least: int, most: int, scored: Column | None = None) -> DataFrame:
    """``df`` with ``drop_reason``: null inside the band, "too_short" also where nothing is scored, "too_long"."""
    nothing = F.lit(False) if scored is None else F.coalesce(scored, F.lit(0)) <= 0
    n = F.coalesce(F.col(tokens), F.lit(0))
    return df.withColumn("drop_reason", F.when((n < least) | nothing, "too_short").when(n > most, "too_long"))
