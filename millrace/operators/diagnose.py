"""Why a model fails: cells, gaps, confusions, couplings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import correlation, rate, spearman

#: A cell with fewer held-out rows says little. Fixed value.
THIN = 20


def rates(graded: DataFrame, by: str) -> DataFrame:
    """``by, n, well_formed, correct`` and their rates for every category, and for all in a row whose ``by`` is null."""
    r = graded.rollup(by).agg(F.grouping(by).alias("__all"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("fault").isNull()).alias("well_formed"), F.count_if("correct").alias("correct"))
    return r.where(F.col(by).isNotNull() | (F.col("__all") == 1)).select(by, "n", "well_formed", "correct", rate(F.col("well_formed"), F.col("n")).alias("well_formed_rate"), rate(F.col("correct"), F.col("n")).alias("correct_rate"))


def cell_report(train: DataFrame, val: DataFrame, train_graded: DataFrame, cell: list[str]) -> DataFrame:
    """A row per cell of any side: training rows and their share, held-out rows and rates, graded training rows and rate, thin or not. Rates of nothing are null."""
    t = train.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_train"))
    v = val.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_val"), F.count_if(F.col("fault").isNull()).alias("w"), F.count_if("correct").alias("c"))
    g = train_graded.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_train_graded"), F.count_if("correct").alias("tc"))
    d = t.join(v, cell, "full").join(g, cell, "left").fillna({"n_train": 0, "n_val": 0, "n_train_graded": 0})
    total = F.sum("n_train").over(Window.partitionBy())  # one row per cell
    return d.select(*cell, "n_train", F.coalesce(F.try_divide(F.col("n_train").cast("double"), total.cast("double")), F.lit(0.0)).alias("train_share"), "n_val", F.try_divide(F.col("w").cast("double"), F.col("n_val")).alias("well_formed_rate"), F.try_divide(F.col("c").cast("double"), F.col("n_val")).alias("correct_rate"), "n_train_graded", F.try_divide(F.col("tc").cast("double"), F.col("n_train_graded")).alias("train_correct_rate"), (F.col("n_val") < THIN).alias("thin"))


#: Limits of the verdict on a model: mean of training, median gap, mean of held-out rates. Fixed values.
LEARNED, GAP, SOUND = 0.5, 0.25, 0.6
#: Least agreement with known answers for a judge to be trusted. Fixed value.
TRUSTED = 0.8


def memorisation_gap(cells: DataFrame) -> DataFrame:
    """One row over cells with enough rows on both sides: ``cells, train_mean, val_mean, median_gap, max_gap, dead_cells, verdict``."""
    c = cells.where((F.col("n_train_graded") >= THIN) & (F.col("n_val") >= THIN) & F.col("train_correct_rate").isNotNull() & F.col("correct_rate").isNotNull())
    gap = F.col("train_correct_rate") - F.col("correct_rate")
    a = c.agg(F.count(F.lit(1)).alias("cells"), F.avg("train_correct_rate").alias("train_mean"), F.avg("correct_rate").alias("val_mean"), F.median(gap).alias("median_gap"), F.max(gap).alias("max_gap"), F.count_if(F.col("correct_rate") == 0).alias("dead_cells"))
    verdict = F.when(F.col("cells") == 0, "not_measured").when(F.col("train_mean") < LEARNED, "capacity").when(F.col("median_gap") > GAP, "memorisation").when((F.col("val_mean") < SOUND) | (F.col("dead_cells") > 0), "uniform").otherwise("generalising")
    return a.withColumn("verdict", verdict)


def volume_correlation(cells: DataFrame) -> DataFrame:
    """``cells, rho, reading`` of training volume against held-out accuracy over cells that aren't thin."""
    s = spearman(cells.where(~F.col("thin")), "n_train", "correct_rate")
    return s.withColumn("reading", F.when(F.col("rho").isNull(), "too_few_cells").when(F.col("rho") > 0.5, "composition").when(F.col("rho") < -0.5, "inverted").otherwise("not_volume"))


def top(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The ``k`` most frequent combinations of ``by`` with their number, ties by first occurrence."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return g.orderBy(F.desc("n"), "__first", *by).limit(k).drop("__first")


def default_call(graded: DataFrame, name: str, order: str) -> DataFrame:
    """The calls of wrong but well-formed replies: ``name, n, share`` of the twelve most frequent."""
    wrong = graded.where("fault is null and not correct")
    g = wrong.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per name
    return g.orderBy(F.desc("n"), "__first", name).limit(12).select(name, "n", "share")


def confusion(graded: DataFrame, expected: str, got: str, order: str, k: int = 25) -> DataFrame:
    """``expected, got, n, correct_name`` of well-formed replies."""
    return top(graded.where("fault is null"), [expected, got], order, k).withColumn("correct_name", F.col(expected).eqNullSafe(F.col(got)))


def coupling(rows: DataFrame, think: Column, tools: Column, called: Column, knew: Column | None = None) -> DataFrame:
    """``considered, agreed, decoupled, decoupled_rate`` over replies whose reasoning names just one of the tools; with ``knew``, a condition on a reply, the number of those too."""
    named = F.array_distinct(F.filter(tools, lambda t: F.rlike(think, F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b")))))
    d = rows.select(named.alias("named"), called.alias("called"), F.coalesce(knew if knew is not None else F.lit(False), F.lit(False)).alias("knew"))
    one = F.size("named") == 1
    a = d.agg(F.count_if(one).alias("considered"), F.count_if(one & (F.col("named")[0] == F.col("called"))).alias("agreed"), F.count_if("knew").alias("knew_but_missed"))
    out = a.select("considered", "agreed", (F.col("considered") - F.col("agreed")).alias("decoupled"), F.try_divide((F.col("considered") - F.col("agreed")).cast("double"), F.col("considered")).alias("decoupled_rate"), "knew_but_missed")
    return out if knew is not None else out.drop("knew_but_missed")


def worst(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group, the worst first; without ``by`` of all. Spark cuts to ``k`` before it shuffles."""
    if not by:
        return rows.orderBy(*order).limit(k)
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def widest_gaps(cells: DataFrame, cell: list[str], k: int = 5) -> DataFrame:
    """The ``k`` cells, with enough rows on both sides, in which training is furthest ahead."""
    c = cells.where((F.col("n_train_graded") >= THIN) & (F.col("n_val") >= THIN)).withColumn("gap", F.col("train_correct_rate") - F.col("correct_rate"))
    return worst(c.where("gap is not null").select(*cell, "gap"), [], [F.desc("gap"), *cell], k)


def worst_cells(cells: DataFrame, cell: list[str], k: int = 8) -> DataFrame:
    """The ``k`` cells with the least correct rate that is known and not from a thin cell."""
    return worst(cells.where(~F.col("thin") & F.col("correct_rate").isNotNull()).select(*cell, "n_val", "correct_rate"), [], ["correct_rate", *cell], k)


def exact_metrics(graded: DataFrame, got: str, want: str, got_name: str, want_name: str, group: str) -> DataFrame:
    """One row without a judge: ``n, well_formed, right_tool, right_tool_args, pairs, grounded, identical_pairs``.

    ``got`` and ``want`` are canonical first calls, null where there is none. Tools and arguments count over replies of which both are
    known; pairs are groups of two replies, grounded if both are right, identical if both call the same.
    """
    both = F.col(got).isNotNull() & F.col(want).isNotNull()
    a = graded.agg(F.count(F.lit(1)).alias("n"), F.count(got).alias("formed"), F.count_if(both).alias("known"), F.count_if(both & (F.col(got_name) == F.col(want_name))).alias("tool"), F.count_if(both & (F.col(got) == F.col(want))).alias("args"))
    p = graded.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(got) == F.col(want)).alias("right"), F.min(F.coalesce(got, F.lit(""))).alias("lo"), F.max(F.coalesce(got, F.lit(""))).alias("hi")).where("k = 2")
    p = p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("right") == 2).alias("grounded"), F.count_if(F.col("lo") == F.col("hi")).alias("identical_pairs"))
    return a.crossJoin(p).select("n", rate(F.col("formed"), F.col("n")).alias("well_formed"), rate(F.col("tool"), F.col("known")).alias("right_tool"), rate(F.col("args"), F.col("known")).alias("right_tool_args"), "pairs", "grounded", "identical_pairs")  # one row each


def agreement(scores: DataFrame, item: list[str], judge: str, score: str, a: str, b: str) -> DataFrame:
    """``n, correlation, mean_difference`` of two judges' scores of the same items, those that both gave; of several scores of an item and judge the mean. Items are joined by key, never by place."""
    ok = scores.where(F.col(score) >= 0)
    both = ok.groupBy(*item).agg(F.avg(F.when(F.col(judge) == a, F.col(score))).alias("x"), F.avg(F.when(F.col(judge) == b, F.col(score))).alias("y")).where("x is not null and y is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("correlation"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_difference"))


def preflight(graded: DataFrame, by: list[str], reply: str, opening: str = "<think>") -> DataFrame:
    """``seen, parsed, usable, preamble, rejects``: replies, those that could be read, those without a fault, those with text before the first tag, and the number of each fault."""
    parsed = F.col("fault").isNull() | ~F.col("fault").isin("no_think", "no_response")
    fault = graded.groupBy(*by, "fault").agg(F.count(F.lit(1)).alias("k"), F.count_if(parsed).alias("p"), F.count_if(F.instr(reply, opening) > 1).alias("b"))
    rejects = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("fault").isNotNull(), F.struct("fault", "k")))))  # a row per fault
    return fault.groupBy(*by).agg(F.sum("k").alias("seen"), F.sum("p").alias("parsed"), F.coalesce(F.sum(F.when(F.col("fault").isNull(), F.col("k"))), F.lit(0)).alias("usable"), F.sum("b").alias("preamble"), rejects.alias("rejects"))


def as_table(rows: DataFrame, most: int = 50) -> str:
    """A small report as text, columns of one width, numbers to the right; ``most`` rows and a note on the rest."""
    got = rows.limit(most + 1).collect()
    show = lambda x: "-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)
    lines = [rows.columns, *[[show(x) for x in r] for r in got[:most]]]
    width = [max(len(r[i]) for r in lines) for i in range(len(rows.columns))]
    number = [all(isinstance(r[i], (int, float)) or r[i] is None for r in got) for i in range(len(width))]
    text = ["  ".join(x.rjust(w) if n else x.ljust(w) for x, w, n in zip(r, width, number)).rstrip() for r in lines]
    return "\n".join(text + (["..."] if len(got) > most else []))


def failure_modes(rows: DataFrame, modes: list[tuple[str, Column]], other: str) -> DataFrame:
    """``mode, n, share``: the first mode of each row whose condition holds."""
    mode = F.coalesce(*[F.when(c, F.lit(n)) for n, c in modes], F.lit(other))
    g = rows.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_buckets(rows: DataFrame, length: Column, edges: list[int], hit: Column) -> DataFrame:
    """``bucket, n, hits, rate`` of half-open buckets between the edges; empty ones have no row."""
    names = [f"<{edges[0]}", *[f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])], f">={edges[-1]}"]
    bucket = F.coalesce(*[F.when(length < e, F.lit(n)) for e, n in zip(edges, names)], F.lit(names[-1]))
    g = rows.where(length.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return g.withColumn("rate", F.col("hits") / F.col("n"))


def dedup_forensics(rows: DataFrame, cell: list[str], fingerprint: Column, kept: Column) -> DataFrame:
    """``cell, n, kept, kept_rate, distinct_texts, exact_dup_rate, largest_cluster``; rows are counted per fingerprint before they are gathered."""
    f = rows.groupBy(*cell, fingerprint.alias("__f")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(kept).alias("__k"))
    g = f.groupBy(*cell).agg(F.sum("__n").alias("n"), F.sum("__k").alias("kept"), F.count(F.lit(1)).alias("distinct_texts"), F.max("__n").alias("largest_cluster"))
    return g.select(*cell, "n", "kept", (F.col("kept") / F.col("n")).alias("kept_rate"), "distinct_texts", (1 - F.col("distinct_texts") / F.col("n")).alias("exact_dup_rate"), "largest_cluster")


def judge_summary(verdicts: DataFrame, dimension: str, score: str) -> DataFrame:
    """``dimension, n, n_scored, unparsed_rate, mean, distribution``; a null score is unparsed and never a 0."""
    c = verdicts.groupBy(dimension, score).agg(F.count(F.lit(1)).alias("__n"))
    spread = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("k"), F.col("__n").alias("v"))))))
    g = c.groupBy(dimension).agg(F.sum("__n").alias("n"), F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col("__n"))), F.lit(0)).alias("n_scored"), F.sum(F.col(score) * F.col("__n")).alias("__s"), spread.alias("distribution"))
    return g.select(dimension, "n", "n_scored", (1 - F.col("n_scored") / F.col("n")).alias("unparsed_rate"), F.try_divide(F.col("__s").cast("double"), F.col("n_scored")).alias("mean"), "distribution")


def calibration(rows: DataFrame, score: Column, correct: Column, good: int = 4) -> DataFrame:
    """``n, agreement, false_pass, false_fail, trustworthy`` of a judge against known answers; unscored rows don't count."""
    passed = score >= good
    a = rows.where(score.isNotNull() & correct.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed == correct).alias("agree"), F.count_if(passed & ~correct).alias("false_pass"), F.count_if(~passed & correct).alias("false_fail"))
    agreement = F.try_divide(F.col("agree").cast("double"), F.col("n"))
    return a.select("n", agreement.alias("agreement"), "false_pass", "false_fail", F.coalesce(agreement >= TRUSTED, F.lit(False)).alias("trustworthy"))


def score_table(rows: DataFrame, label: str, category: str, score: str, categories: list[str]) -> DataFrame:
    """``label``, a mean score per category, ``overall``, ``good_share`` of 4 and more, ``unparsed``; unparsed scores are null or negative."""
    ok = F.col(score) >= 0
    g = rows.groupBy(label)
    means = [F.try_divide(F.sum(F.when(ok & (F.col(category) == c), F.col(score))).cast("double"), F.count_if(ok & (F.col(category) == c))).alias(c) for c in categories]
    n = F.count_if(ok)
    return g.agg(*means, F.try_divide(F.sum(F.when(ok, F.col(score))).cast("double"), n).alias("overall"), F.try_divide(F.count_if(F.col(score) >= 4).cast("double"), n).alias("good_share"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("unparsed"))


def retained(checkpoints: DataFrame, step: str, keep_last: int, save_every: int, total: int) -> DataFrame:
    """``step, kept``: the last checkpoints, and those within one save of a tenth of the run. The catalogue is small."""
    r = F.row_number().over(Window.orderBy(F.desc(step)))
    near = F.exists(F.sequence(F.lit(1), F.lit(10)), lambda k: F.abs(F.col(step) - F.bround(F.lit(total) * k / 10)) < save_every)
    return checkpoints.withColumn("kept", (r <= keep_last) | (near if total > 0 else F.lit(False)))
