"""Queries of the core operators over whole tables, each beside the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import jsonx, render, stats, text
from millrace.functions.names import LANG_ALIASES, MISSING_WORDS, key, lang
from millrace.operators import dedup, diagnose, mixture, order, pack, pairs, split, validate
from millrace.operators.components import connected_components
from millrace.operators.skew import lookup
from millrace.plans import corpus
from millrace.sources import readers
from millrace.sources.tables import table
from millrace.workspace import materialise

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_MISSING = ", ".join(f"'{w}'" for w in MISSING_WORDS)


def _plain(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '[\\s_-]+', '_', 'g')"


def _key(c: str) -> str:
    return f"(case when {_plain(c)} not in ({_MISSING}) then {_plain(c)} end)"


def _lang(c: str) -> str:
    head = f"split_part({_key(c)}, '_', 1)"
    return f"(case {head} {' '.join(f"when '{a}' then '{n}'" for a, n in LANG_ALIASES.items())} else {head} end)"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scans, filters, projections


@query("select doc_id, source, n_chars from documents where int_score >= 4 and length(text) > 0")
def tier_filter(spark, d):
    return readers.tier_scan(table(spark, d, "documents"), 4).select("doc_id", "source", "n_chars")


@query(f"""with d as (select *, {_key('source')} k from documents)
select part_no, epoch, doc_id from (select 0 part_no, unnest(range(0, 3)) epoch, doc_id from d where k = 'tool_calling' union all select 1, 0, doc_id from d where k = 'math_pages')""")
def epoch_repeat_union(spark, d):
    docs = table(spark, d, "documents").withColumn("k", key(F.col("source"))).select("doc_id", "k")
    first = readers.epochs(docs.where("k = 'tool_calling'"), 3)
    second = readers.epochs(docs.where("k = 'math_pages'"), 1)
    return readers.in_sequence(first, second).select(F.col("part_no").cast("bigint").alias("part_no"), F.col("epoch").cast("bigint").alias("epoch"), "doc_id")


@query("select lang, count(*) n, sum(n_chars)::bigint chars from documents where lang in ('de', 'fr', 'ja') group by lang")
def partition_scan(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr", "ja")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"select {_lang('lang')} lang, count(*) n, sum(n_chars)::bigint chars from documents where {_lang('lang')} in ('de', 'fr', 'ja') group by 1")
def partition_scan_plain(spark, d):
    """``partition_scan`` by language, in whatever code."""
    docs = table(spark, d, "documents").select(lang(F.col("lang")).alias("lang"), "n_chars").where(F.col("lang").isin("de", "fr", "ja"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"select {_key('source')} source, {_key('domain')} \"domain\", count(*) n, count(distinct origin) origins from documents group by all")
def plain_names(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(key(F.col("source")).alias("source"), key(F.col("domain")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("origin").alias("origins"))


@query("select id, case when trim(coalesce(request, '')) = '' then null when trim(coalesce(state, '')) = '' then request else state || chr(10) || chr(10) || request end doc from requests")
def join_parts_render(spark, d):
    r = table(spark, d, "requests")
    doc = render.chat_document(F.col("state"), F.col("request"))
    return r.select("id", doc.alias("doc"))


@query("""with t as (select id, loaded_utc, unnest(list_zip(turns, range(1, len(turns) + 1))) x from examples)
select id, loaded_utc, string_agg('<|' || x[1].role || '|>' || chr(10) || coalesce(x[1].text, x[1].result, coalesce('<think>' || x[1].think || '</think>', '') || coalesce(x[1].calls, '')) , chr(10) order by x[2]) doc,
sum(case when x[1].role = 'assistant' then 1 else 0 end)::bigint scored from t group by all""")
def chat_render(spark, d):
    body = lambda t: F.coalesce(t["text"], t["result"], F.concat(F.coalesce(F.concat(F.lit("<think>"), t["think"], F.lit("</think>")), F.lit("")), F.coalesce(t["calls"], F.lit(""))))
    parts = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), body(t)))
    return table(spark, d, "examples").groupBy("id", "loaded_utc", F.array_join(parts, "\n").alias("doc")).agg(F.sum(F.size(validate.assistant_turns(F.col("turns")))).alias("scored"))


@query("""select id, json_extract_string(state, '$.machines[0].id') machine, json_extract(state, '$.stock') is not null has_stock, json_extract_string(memory, '$.recent[0]') recent from requests where state is not null""")
def json_pointer_get(spark, d):
    r = table(spark, d, "requests").where("state is not null")
    return r.select("id", F.get_json_object("state", "$.machines[0].id").alias("machine"), F.get_json_object("state", "$.stock").isNotNull().alias("has_stock"), F.get_json_object("memory", "$.recent[0]").alias("recent"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def variant_get(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query()
def state_schema(spark, d):
    """Pointers of all leaves of the states and in how many states each comes."""
    r = table(spark, d, "requests").where("state is not null").select(F.explode(jsonx.leaf_paths("state")).alias("pointer"))
    return r.groupBy("pointer").agg(F.count(F.lit(1)).alias("n"))


@query()
def branch_state_diff(spark, d):
    """Where the states of a pair's branches differ."""
    p = pairs.pivot_pairs(table(spark, d, "requests"), "pair_id", "branch", "loaded_utc", ["state"])
    return p.where("a is not null and b is not null").select("pair_id", jsonx.diff_paths(F.col("a.state"), F.col("b.state")).alias("pointers"))


@query()
def canonical_replies(spark, d):
    """The calls of every reply in canonical form."""
    o = table(spark, d, "outputs")
    return o.select("output_id", "loaded_utc", jsonx.canonical_calls(text.response(F.col("response"))).alias("calls"), jsonx.first_calls(F.col("response")).alias("first"))


_REPLY = "coalesce(response, '') || ['SCORE: ', 'the score is ', 'Score : ', 'score:' || chr(10), 'SCORE: 1' || chr(10) || 'Score: '][output_id % 5 + 1] || coalesce(case when output_id % 7 = 0 then score * 3 else score end::varchar, 'none') || chr(10) || 'REASON: ' || coalesce(reason, '')"


@query(f"""with r as (select output_id, loaded_utc, {_REPLY} x from outputs)
select output_id, loaded_utc, nullif(regexp_extract(x, '(?i)SCORE\\s*:\\s*([0-5])', 1), '')::int first_digit, case when regexp_extract(x, '(?i)SCORE:\\s*(\\d+)', 1) = '' then -1 else least(regexp_extract(x, '(?i)SCORE:\\s*(\\d+)', 1)::int, 5) end clamped,
case when regexp_extract(x, '(?i)SCORE:\\s*(\\d+)', 1) = '' or regexp_extract(x, '(?i)SCORE:\\s*(\\d+)', 1)::int > 5 then -1 else regexp_extract(x, '(?i)SCORE:\\s*(\\d+)', 1)::int end rejected,
coalesce(regexp_extract_all(string_split(x, '</think>')[-1], '(?i)SCORE:\\s*([0-5])\\b', 1)[-1]::int, regexp_extract_all(x, '(?i)SCORE:\\s*([0-5])\\b', 1)[-1]::int, -1) last_digit from r""")
def score_parsers(spark, d):
    """The four parsers on replies as judges write them, rendered from responses, scores and reasons."""
    o = table(spark, d, "outputs")
    said = F.get(F.array(*[F.lit(x) for x in ("SCORE: ", "the score is ", "Score : ", "score:\n", "SCORE: 1\nScore: ")]), (F.col("output_id") % 5).cast("int"))
    number = F.when(F.col("output_id") % 7 == 0, F.col("score") * 3).otherwise(F.col("score")).cast("string")
    reply = F.concat(F.coalesce("response", F.lit("")), said, F.coalesce(number, F.lit("none")), F.lit("\nREASON: "), F.coalesce("reason", F.lit("")))
    return o.select("output_id", "loaded_utc", reply.alias("x")).select("output_id", "loaded_utc", *[text.score(F.col("x"), m).alias(m) for m in text.SCORE_PATTERNS])


@query("""with o as (select *, strpos(response, '<think>') s from outputs)
select output_id, loaded_utc, case when s > 0 and strpos(substr(response, s + 7), '</think>') > 0 then regexp_replace(substr(response, s + 7, strpos(substr(response, s + 7), '</think>') - 1), '^\\s+|\\s+$', '', 'g') end think from o""")
def think_blocks(spark, d):
    return table(spark, d, "outputs").select("output_id", "loaded_utc", text.think(F.col("response")).alias("think"))


@query("select id, regexp_replace(seed_topic, '\\bb_\\d+\\b', '<id>', 'g') topic from requests where seed_topic is not null")
def volatile_ids(spark, d):
    return table(spark, d, "requests").where("seed_topic is not null").select("id", text.without_ids(F.col("seed_topic")).alias("topic"))


# Budgets, windows, mixtures


@query("""with d as (select doc_id, source, len(regexp_extract_all(text, '\\S+'))::bigint n from documents where source is not null),
c as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint b from d),
t as (select source, sum(n) // 2 budget from d group by source)
select source, doc_id, b as "before", least(n, budget - b)::bigint taken from c join t using (source) where b < budget and n > 0""")
def token_budget_prefix(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("bigint").alias("n"))
    docs = materialise(docs, "sizes")  # words are counted once, for the budget and for the prefix
    half = docs.groupBy("source").agg(F.floor(F.sum("n") / 2).alias("budget"))
    return order.token_budget(docs.join(half, "source"), "source", "doc_id", F.col("n"), F.col("budget")).select("source", "doc_id", "before", "taken")


@query(f"""with d as (select doc_id, {_key('source')} source, len(regexp_extract_all(text, '\\S+'))::bigint n from documents),
c as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint b from d where source is not null),
t as (select source, sum(n) // 2 budget from d group by source)
select source, doc_id, b as "before", least(n, budget - b)::bigint taken from c join t using (source) where b < budget and n > 0""")
def token_budget_prefix_plain(spark, d):
    """``token_budget_prefix`` by the source's name: one budget and one sequence for all its spellings."""
    docs = table(spark, d, "documents").select("doc_id", key(F.col("source")).alias("source"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("bigint").alias("n")).where("source is not null")
    docs = materialise(docs, "sizes")  # words are counted once, for the budget and for the prefix
    half = docs.groupBy("source").agg(F.floor(F.sum("n") / 2).alias("budget"))
    return order.token_budget(docs.join(half, "source"), "source", "doc_id", F.col("n"), F.col("budget")).select("source", "doc_id", "before", "taken")


@query("""with b as (select source_key source, max(budget_tokens) // 100000 budget from data_config group by 1),
a as (select """ + _key("source") + """ source, sum(n_chars) actual from documents group by 1),
j as (select b.source, budget::bigint budget, coalesce(actual, 0)::bigint actual from b left join a using (source)),
m as (select least(min(actual::double / budget), 1) s from j)
select 'use_all' "mode", source, budget, actual, (least(actual, budget) // 4096 * 4096)::bigint take from j
union all select 'cap_proportional', source, budget, actual, (floor(budget * s)::bigint // 4096 * 4096)::bigint from j, m""")
def allocation_modes(spark, d):
    b = table(spark, d, "data_config").groupBy(F.col("source_key").alias("source")).agg(F.floor(F.max("budget_tokens") / 100000).alias("budget"))
    a = table(spark, d, "documents").groupBy(key(F.col("source")).alias("source")).agg(F.sum("n_chars").alias("actual"))
    j = b.join(a, "source", "left")
    one = mixture.allocate(j, 4096, "use_all").withColumn("mode", F.lit("use_all"))
    return one.unionByName(mixture.allocate(j, 4096, "cap_proportional").withColumn("mode", F.lit("cap_proportional"))).select("mode", "source", "budget", "actual", "take")


@query(f"""with t as (select sum(n_chars) total from documents), a as (select {_key('source')} source, sum(n_chars) actual from documents group by 1),
b as (select config_id, source_key source, floor(budget_tokens::double / sum(budget_tokens) over (partition by config_id) * mix_ratio * total)::bigint budget, xlam_epochs from data_config, t),
j as (select config_id, b.source, budget, (coalesce(actual, 0) * xlam_epochs)::bigint actual from b left join a using (source)), m as (select config_id, least(min(actual::double / budget), 1) s from j group by 1)
select 'use_all' "mode", config_id, source, budget, actual, (least(actual, budget) // 4096 * 4096)::bigint take from j
union all select 'cap_proportional', config_id, source, budget, actual, (floor(budget * s)::bigint // 4096 * 4096)::bigint from j join m using (config_id)""")
def recipe_allocation(spark, d):
    """Both modes for every recipe over whole tables: budgets are parts of the size of all documents, a source gives at most its epochs."""
    docs = table(spark, d, "documents").groupBy(key(F.col("source")).alias("source")).agg(F.sum("n_chars").alias("n"))
    c = table(spark, d, "data_config")
    share = F.col("budget_tokens").cast("double") / F.sum("budget_tokens").over(Window.partitionBy("config_id"))
    b = c.crossJoin(F.broadcast(docs.agg(F.sum("n").alias("total")))).select("config_id", F.col("source_key").alias("source"), F.floor(share * F.col("mix_ratio") * F.col("total")).alias("budget"), "xlam_epochs")
    j = b.join(docs, "source", "left").withColumn("actual", F.col("n") * F.col("xlam_epochs"))
    modes = [mixture.allocate(j, 4096, m, by=("config_id",)).withColumn("mode", F.lit(m)) for m in ("use_all", "cap_proportional")]
    return modes[0].unionByName(modes[1]).select("mode", "config_id", "source", "budget", "actual", "take")


@query()
def interleave_slots(spark, d):
    """Windows of all sources in one order in which any stretch has the sources' shares."""
    w = order.window_count(table(spark, d, "documents").withColumn("source", key(F.col("source"))), ["source"], F.col("n_chars"), 4096)
    return mixture.interleave(w.where("source is not null"))


@query("""with d as (select doc_id, source, n_chars n, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint p from documents where source is not null),
w as (select *, unnest(range(p // 4096, (p + n - 1) // 4096 + 1)) window_id from d where n > 0)
select source, window_id, count(*) parts, min(doc_id) first_doc, sum(least(p + n, (window_id + 1) * 4096) - greatest(p, window_id * 4096))::bigint tokens from w group by all""")
def window_cut(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source", "n_chars")
    w = order.window_cut(docs, ["source"], "doc_id", F.col("n_chars"), 4096)
    return w.groupBy("source", "window_id").agg(F.count(F.lit(1)).alias("parts"), F.min("doc_id").alias("first_doc"), F.sum("taken").alias("tokens"))


@query(f"""with s as (select doc_id, {_key('source')} source, n_chars n from documents), d as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint p from s where source is not null),
w as (select *, unnest(range(p // 4096, (p + n - 1) // 4096 + 1)) window_id from d where n > 0)
select source, window_id, count(*) parts, min(doc_id) first_doc, sum(least(p + n, (window_id + 1) * 4096) - greatest(p, window_id * 4096))::bigint tokens from w group by all""")
def window_cut_plain(spark, d):
    """``window_cut`` by the source's name."""
    docs = table(spark, d, "documents").select("doc_id", key(F.col("source")).alias("source"), "n_chars").where("source is not null")
    w = order.window_cut(docs, ["source"], "doc_id", F.col("n_chars"), 4096)
    return w.groupBy("source", "window_id").agg(F.count(F.lit(1)).alias("parts"), F.min("doc_id").alias("first_doc"), F.sum("taken").alias("tokens"))


@query("""with c as (select category, paired, round_even(30000 * share, 0)::bigint p from category_specs),
e as (select category, paired, case when paired then p + p % 2 else p end p from c)
select category, paired, (p + case when category = (select arg_max(category, p) from e where not paired) then 30000 - (select sum(p) from e) else 0 end)::bigint planned from e""")
def plan_category_counts(spark, d):
    return mixture.plan_counts(table(spark, d, "category_specs"), 30_000)


def binpack_items(spark, d):
    """Examples with their number of words."""
    words = text.word_count(F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], t["think"], F.lit(""))), " "))
    return table(spark, d, "examples").groupBy("id").agg(F.max(words).cast("bigint").alias("n"))


@query()
def binpack(spark, d):
    """Whole examples in windows of 1,024 words."""
    return pack.bin_pack(binpack_items(spark, d), "id", "n", 1024)


@query()
def binpack_stats(spark, d):
    """Windows and utilisation of the packing."""
    return pack.pack_stats(binpack(spark, d), "n", 1024)


@query("""with g as (select coalesce(group_key, 'solo ' || output_id) g, count(*) n, md5(coalesce(group_key, 'solo ' || output_id)) h from outputs group by 1),
b as (select g, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) b from g)
select output_id, loaded_utc, case when b < round_even((select count(*) from outputs) * 0.1, 0) then 'val' else 'train' end split from outputs join b on g = coalesce(group_key, 'solo ' || output_id)""")
def group_split(spark, d):
    o = table(spark, d, "outputs").select("output_id", "loaded_utc", "group_key")
    g = F.coalesce("group_key", F.concat(F.lit("solo "), F.col("output_id").cast("string")))
    top = F.conv(F.substring(F.md5(F.col("__group")), 1, 15), 16, 10).cast("bigint") * 8
    return split.validation_split(o, g, 0.1, order=top).select("output_id", "loaded_utc", "split")


@query(f"""with o as materialized (select output_id, loaded_utc, coalesce({_key('group_key')}, 'solo ' || output_id) g from outputs), g as (select g, count(*) n, md5(g) h from o group by g),
b as (select g, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) b from g)
select output_id, loaded_utc, case when b < round_even((select count(*) from outputs) * 0.1, 0) then 'val' else 'train' end split from o join b using (g)""")
def group_split_plain(spark, d):
    """``group_split`` by the group's name: its spellings stay together, an output without a usable key is alone."""
    o = table(spark, d, "outputs").select("output_id", "loaded_utc", "group_key")
    g = F.coalesce(key(F.col("group_key")), F.concat(F.lit("solo "), F.col("output_id").cast("string")))
    top = F.conv(F.substring(F.md5(F.col("__group")), 1, 15), 16, 10).cast("bigint") * 8
    return split.validation_split(o, g, 0.1, order=top).select("output_id", "loaded_utc", "split")


# Deduplication


@query()
def minhash_dedup(spark, d):
    """Documents by banded MinHash: kept or dropped in favour of an earlier one."""
    return dedup.dedup(table(spark, d, "documents"), "doc_id", "text")


@query()
def minhash_group_dedup(spark, d):
    """Examples with a group kept or dropped whole."""
    e = readers.last_wins(table(spark, d, "examples").select("id", "group_key", "turns", "loaded_utc"), ["id"], "loaded_utc")
    fp = F.array_join(F.transform("turns", lambda t: F.coalesce(text.without_ids(t["text"]), t["calls"], F.lit(""))), "\n")
    return dedup.dedup_groups(e.select("id", key(F.col("group_key")).alias("g"), fp.alias("fp")), "g", "id", "fp").select("id", "kept")


@query("select id, case when row_number() over (partition by seed_topic order by id, loaded_utc) = 1 then true else false end kept, loaded_utc from requests where seed_topic is not null")
def exact_first_wins(spark, d):
    r = table(spark, d, "requests").where("seed_topic is not null").select("id", "seed_topic", "loaded_utc")
    first = r.groupBy("seed_topic").agg(F.min(F.struct("id", "loaded_utc")).alias("first"))
    return lookup(r, first, "seed_topic").select("id", (F.struct("id", "loaded_utc") == F.col("first")).alias("kept"), "loaded_utc")


@query(f"""with d as (select doc_id, {_key('source')} source, md5(text) f, doc_id = min(doc_id) over (partition by md5(text)) k from documents),
f as (select source, f, count(*) n, count(*) filter (k) k from d group by all)
select source, sum(n)::bigint n, sum(k)::bigint kept, sum(k)::bigint / sum(n)::double kept_rate, count(*)::bigint distinct_texts, 1 - count(*) / sum(n)::double exact_dup_rate, max(n) largest_cluster from f group by source""")
def fingerprint_exact_dups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", key(F.col("source")).alias("source"), F.md5("text").alias("f"))
    first = docs.groupBy("f").agg(F.min(F.struct("doc_id", "source")).alias("first"))
    k = lookup(docs, first, "f").select("source", "f", (F.col("doc_id") == F.col("first.doc_id")).alias("k"))
    return diagnose.dedup_forensics(k, ["source"], F.col("f"), F.col("k"))


@query("select distinct e.id from examples e where not exists (select 1 from outputs o where o.group_key = e.group_key) ")
def top_up_new(spark, d):
    e, o = table(spark, d, "examples"), table(spark, d, "outputs")
    return e.join(o.select("group_key"), "group_key", "left_anti").select("id").distinct()


@query()
def top_up_deduped(spark, d):
    """Examples loaded after the mean time as additions to those loaded before: without ids that are there and near-duplicates, groups whole."""
    fp = F.array_join(F.transform("turns", lambda t: F.coalesce(text.without_ids(t["text"]), t["calls"], F.lit(""))), "\n")
    e = table(spark, d, "examples").select("id", key(F.col("group_key")).alias("g"), fp.alias("fp"), F.unix_seconds(F.to_timestamp("loaded_utc")).alias("at"))
    e = e.crossJoin(F.broadcast(e.agg(F.floor(F.sum("at") / F.count("at")).alias("mean"))))
    return dedup.top_up_deduped(e.where("at is null or at <= mean"), e.where("at > mean"), "id", "g", "fp").select("id")


# Joins and sets


@query("select r.id, r.loaded_utc from requests r where not exists (select 1 from examples e where e.id = r.id)")
def resume_anti_join(spark, d):
    return readers.unfinished(table(spark, d, "requests"), table(spark, d, "examples")).select("id", "loaded_utc")


@query("""select pair_id, arg_max(id, loaded_utc) filter (branch = 'a') a_id, arg_max(id, loaded_utc) filter (branch = 'b') b_id from requests where pair_id is not null group by pair_id""")
def pair_pivot_last_wins(spark, d):
    p = pairs.pivot_pairs(table(spark, d, "requests"), "pair_id", "branch", "loaded_utc", ["id"])
    return p.select("pair_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("select pair_id, list_sort(list_distinct(list(branch))) branches from examples join (select distinct id, pair_id from requests) using (id) where pair_id is not null group by pair_id having list_sort(list_distinct(list(branch))) <> ['a', 'b']")
def pair_integrity(spark, d):
    e = table(spark, d, "examples").select("id", "branch").join(table(spark, d, "requests").select("id", "pair_id").distinct(), "id")
    return pairs.integrity(e, "pair_id", "branch")


@query(f"""with r as (select {_key('category')} category, count(*) n from requests group by 1), e as (select {_key('category')} category, count(*) n from examples group by 1), o as (select {_key('category')} category, count(*) n from outputs group by 1)
select category, coalesce(r.n, 0) planned, coalesce(e.n, 0) made, coalesce(o.n, 0) scored from r full join e using (category) full join o using (category) where category is not null""")
def funnel(spark, d):
    parts = [table(spark, d, t).groupBy(key(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias(n)) for t, n in (("requests", "planned"), ("examples", "made"), ("outputs", "scored"))]
    j = parts[0].join(parts[1], "category", "full").join(parts[2], "category", "full")
    return j.where("category is not null").fillna(0)


@query(f"""select s.category, s.share, count(r.id) n, count(r.id) / any_value(t.n)::double - s.share drift from (select count(*) n from requests where {_key('category')} is not null) t cross join category_specs s left join requests r on {_key('r.category')} = s.category group by s.category, s.share""")
def share_drift(spark, d):
    r = table(spark, d, "requests").groupBy(key(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n")).where("category is not null")
    r = r.withColumn("total", F.sum("n").over(Window.partitionBy()))
    j = F.broadcast(table(spark, d, "category_specs").select("category", "share")).join(r, "category", "left")
    return j.select("category", "share", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.max("total").over(Window.partitionBy()) - F.col("share")).alias("drift"))


@query("select spec_id from (select spec_id from examples where spec_id is not null intersect select spec_id from outputs where spec_id is not null)")
def shared_specs(spark, d):
    return table(spark, d, "examples").where("spec_id is not null").select("spec_id").intersect(table(spark, d, "outputs").where("spec_id is not null").select("spec_id"))


@query("select subtype from (select subtype from requests except select subtype from outputs)")
def unscored_subtypes(spark, d):
    return table(spark, d, "requests").select("subtype").subtract(table(spark, d, "outputs").select("subtype"))


@query(f"select spec_id from (select {_key('spec_id')} spec_id from examples intersect select {_key('spec_id')} from outputs) where spec_id is not null")
def shared_specs_plain(spark, d):
    """``shared_specs`` by name."""
    named = [table(spark, d, t).select(key(F.col("spec_id")).alias("spec_id")).where("spec_id is not null") for t in ("examples", "outputs")]
    return named[0].intersect(named[1])


@query(f"select subtype from (select {_key('subtype')} subtype from requests except select {_key('subtype')} from outputs) where subtype is not null")
def unscored_subtypes_plain(spark, d):
    """``unscored_subtypes`` by name."""
    named = [table(spark, d, t).select(key(F.col("subtype")).alias("subtype")).where("subtype is not null") for t in ("requests", "outputs")]
    return named[0].subtract(named[1])


@query("""with recursive e as (select distinct c_custkey a, c_nationkey + 1000000000 b from customer where c_acctbal < 0 union select distinct o_custkey, o_custkey from orders),
r(a, b) as (select distinct a, b from e where a <> b union select b, a from e where a <> b), t as (select a, b from r union select t.a, r.b from t join r on r.a = t.b)
select a node, least(a, min(b)) root from t group by a""")
def negative_balance_components(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("bigint").alias("a"), (F.col("c_nationkey") + 1000000000).cast("bigint").alias("b"))
    roots = connected_components(c)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))


# Validation and grading


@query("""with t as (select id, loaded_utc, list_filter([x.role for x in turns], lambda x: x <> 'user') r from examples)
select id, loaded_utc, len(r) % 2 = 1 and len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> case when i % 2 = 1 then 'assistant' else 'tool' end)) = 0 ok from t""")
def turn_order(spark, d):
    return table(spark, d, "examples").select("id", "loaded_utc", validate.well_ordered(F.col("turns")).alias("ok"))


@query()
def record_faults(spark, d):
    """The first fault of every example."""
    e = table(spark, d, "examples").withColumn("category", key(F.col("category")))
    paired = F.col("category") == "state_memory_conflict"
    return validate.with_record_fault(e, "fault", turns=F.col("turns"), tools=F.col("tools"), state=F.col("state"), memory=F.col("memory"), bounds=(F.lit(1), F.lit(5)), final_answer=F.lit(False), needs_state=paired, needs_memory=paired).select("id", "loaded_utc", "category", "fault")


@query()
def reject_tally(spark, d):
    """Faults by category, most frequent first."""
    return validate.tally(record_faults(spark, d), "fault", "id", ["category"])


@query("""with n as (select id, loaded_utc, sum(len(regexp_extract_all(coalesce(t.text, t.think, ''), '\\S+')))::bigint n from (select id, loaded_utc, unnest(turns) t from examples) group by all)
select case when n < 60 then 'too_short' when n > 150 then 'too_long' end drop_reason, count(*) n from n group by 1""")
def length_band(spark, d):
    n = F.aggregate("turns", F.lit(0), lambda a, t: a + F.size(F.regexp_extract_all(F.coalesce(t["text"], t["think"], F.lit("")), F.lit(r"\S+"), F.lit(0))))
    e = table(spark, d, "examples").select("id", "loaded_utc", n.alias("n")).distinct()
    return validate.length_band(e, "n", 60, 150).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def _graded(spark, d):
    o = readers.last_wins(table(spark, d, "outputs"), ["output_id"], "loaded_utc").withColumn("category", key(F.col("category"))).withColumn("subtype", key(F.col("subtype")))
    return validate.graded(o, "response", "expected")


@query()
def graded_replies(spark, d):
    """Every reply's fault, and whether its first call is the one expected."""
    return _graded(spark, d).select("output_id", "fault", "correct")


@query()
def category_rates(spark, d):
    """Well-formed and correct replies by category and of all."""
    return diagnose.rates(_graded(spark, d), "category")


@query()
def reply_faults(spark, d):
    """Faults of replies, most frequent first."""
    return validate.tally(_graded(spark, d), "fault", "output_id")


@query()
def reply_confusion(spark, d):
    """Names of expected and given calls, the 25 most frequent (the report's own length)."""
    g = _graded(spark, d).withColumn("want", F.get(jsonx.call_names("expected"), F.lit(0))).withColumn("got", F.get(jsonx.call_names(text.response(F.col("response"))), F.lit(0)))
    return diagnose.confusion(g, "want", "got", "output_id")


@query()
def reply_default_call(spark, d):
    """What wrong replies call."""
    g = _graded(spark, d).withColumn("got", F.get(jsonx.call_names(text.response(F.col("response"))), F.lit(0)))
    return diagnose.default_call(g, "got", "output_id")


@query()
def reply_pair_outcomes(spark, d):
    """Both, one or neither reply of a group of two correct."""
    return pairs.outcomes(_graded(spark, d).withColumn("g", key(F.col("group_key"))), "g")


@query()
def think_coupling(spark, d):
    """Whether the reasoning names the tool that is called, of all tools that requests offer; outputs don't name their own."""
    tools = table(spark, d, "requests").select(F.explode("tools").alias("t")).agg(F.collect_set("t").alias("offered"))  # names of tools, a small table
    g = _graded(spark, d).where("fault is null").crossJoin(F.broadcast(tools))
    return diagnose.coupling(g, text.think(F.col("response")), F.col("offered"), F.get(jsonx.call_names(text.response(F.col("response"))), F.lit(0)))


_LAST = f"""o as (select output_id, arg_max(score, loaded_utc) score, any_value({_key('category')}) category, any_value({_key('subtype')}) subtype, any_value({_key('group_key')}) g, any_value(run_label) run_label, any_value(judge) judge from outputs group by 1)"""


def _scored(spark, d):
    o = table(spark, d, "outputs").groupBy("output_id").agg(F.max_by("score", "loaded_utc").alias("score"), *[F.max(key(F.col(c))).alias(n) for c, n in (("category", "category"), ("subtype", "subtype"), ("group_key", "g"))], F.max("run_label").alias("run_label"), F.max("judge").alias("judge"))
    return o


@query(f"""with {_LAST}, c as (select category, score, count(*) n from o group by all)
select category, sum(n)::bigint n, coalesce(sum(n) filter (score is not null), 0)::bigint n_scored, 1 - coalesce(sum(n) filter (score is not null), 0)::bigint / sum(n)::bigint unparsed_rate, sum(score * n)::double / nullif(sum(n) filter (score is not null), 0)::bigint mean from c group by category""")
def judge_summary(spark, d):
    return diagnose.judge_summary(_scored(spark, d), "category", "score").drop("distribution")


@query(f"""with {_LAST} select run_label, sum(score) filter (score >= 0)::double / count(*) filter (score >= 0) overall, count(*) filter (score >= 4)::double / count(*) filter (score >= 0) good_share, count(*) filter (score is null or score < 0) unparsed,
sum(score) filter (score >= 0 and category = 'traps')::double / nullif(count(*) filter (score >= 0 and category = 'traps'), 0) traps, sum(score) filter (score >= 0 and category = 'refusals')::double / nullif(count(*) filter (score >= 0 and category = 'refusals'), 0) refusals from o group by run_label""")
def score_table(spark, d):
    return diagnose.score_table(_scored(spark, d), "run_label", "category", "score", ["traps", "refusals"])


@query(f"""with {_LAST}, p as (select g, min(score) lo, max(score) hi, count(*) n from o where g is not null and score is not null group by g having count(*) = 2)
select count(*) pairs, count(*) filter (lo >= 4) grounded, count(*) filter (lo < 4 and hi >= 4) one_branch from p""")
def judged_pairs(spark, d):
    return pairs.judged_outcomes(_scored(spark, d), "g", "score")


@query(f"""with {_LAST} select count(*) n, count(*) filter ((score >= 4) = (category = 'traps'))::double / count(*) agreement, count(*) filter (score >= 4 and category <> 'traps') false_pass, count(*) filter (score < 4 and category = 'traps') false_fail,
count(*) filter ((score >= 4) = (category = 'traps'))::double / count(*) >= 0.8 trustworthy from o where score is not null and category is not null""")
def judge_calibration(spark, d):
    return diagnose.calibration(_scored(spark, d), F.col("score"), F.col("category") == "traps")


@query(f"""with {_LAST}, t as (select category, subtype, count(*) n from (select distinct id, {_key('category')} category, {_key('subtype')} subtype from examples) group by all),
v as (select category, subtype, count(*) n, count(*) filter (score is not null) w, count(*) filter (coalesce(score >= 4, false)) c from o group by all)
select coalesce(t.category, v.category) category, coalesce(t.subtype, v.subtype) subtype, coalesce(t.n, 0) n_train, coalesce(t.n, 0)::double / sum(t.n) over () train_share, coalesce(v.n, 0) n_val,
w::double / v.n well_formed_rate, c::double / v.n correct_rate, coalesce(v.n, 0) < 20 thin from (select * from t where category is not null and subtype is not null) t full join (select * from v where category is not null and subtype is not null) v on t.category = v.category and t.subtype = v.subtype""")
def cell_report_full_outer(spark, d):
    named = "category is not null and subtype is not null"
    t = table(spark, d, "examples").select("id", key(F.col("category")).alias("category"), key(F.col("subtype")).alias("subtype")).distinct().where(named)
    v = _scored(spark, d).where(named).select("category", "subtype", F.when(F.col("score").isNull(), "unparsed").alias("fault"), F.coalesce(F.col("score") >= 4, F.lit(False)).alias("correct"))
    return diagnose.cell_report(t, v, v.where("false"), ["category", "subtype"]).drop("n_train_graded", "train_correct_rate")


_CELLS = f"""{_LAST}, c as (select category, subtype, count(*) filter (run_label like 'sft%') n_train_graded, count(*) filter (run_label like 'sft%' and score >= 4) tc, count(*) filter (run_label not like 'sft%') n_val, count(*) filter (run_label not like 'sft%' and score >= 4) vc from o where category is not null and subtype is not null group by all),
x as (select tc::double / n_train_graded tr, vc::double / n_val vr from c where n_train_graded >= 20 and n_val >= 20)"""


def _two_sides(spark, d):
    o = _scored(spark, d).where("category is not null and subtype is not null").select("category", "subtype", "run_label", F.lit(None).cast("string").alias("fault"), F.coalesce(F.col("score") >= 4, F.lit(False)).alias("correct"))
    return o.where("run_label like 'sft%'"), o.where("run_label not like 'sft%'")


@query(f"""with {_CELLS} select count(*) cells, median(tr - vr) median_gap, max(tr - vr) max_gap, count(*) filter (vr = 0) dead_cells from x""")
def memorisation_gap(spark, d):
    train, val = _two_sides(spark, d)
    return diagnose.memorisation_gap(diagnose.cell_report(train, val, train, ["category", "subtype"])).select("cells", "median_gap", "max_gap", "dead_cells")


@query("""with p as (select p_size, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 rx, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 ry from part)
select count(*) cells, corr(rx, ry) rho from p""")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice")


@query("""with g as (select o_custkey, sum(case when l_returnflag = 'R' then 1 else 0 end) c, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by 1)
select count(*) filter (n = 2) pairs, count(*) filter (n <> 2) dropped_incomplete, count(*) filter (n = 2 and c = 2) "both", count(*) filter (n = 2 and c = 1) one, count(*) filter (n = 2 and c = 0) neither, coalesce(count(*) filter (n = 2 and c = 2)::double / nullif(count(*) filter (n = 2), 0), 0) grounded_rate from g""")
def pair_outcomes(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return pairs.outcomes(j.withColumn("correct", F.col("l_returnflag") == "R"), "o_custkey")


@query("select l_returnflag, l_linestatus, count(*) n, min(l_orderkey) first from lineitem group by all")
def reject_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def rollup_tally(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, case when value < 10 then '<10' when value < 50 then '10-49' when value < 100 then '50-99' else '>=100' end bucket, count(*) n, count(*) filter (user_id % 2 = 0) hits from events where value is not null group by all""")
def event_buckets(spark, d):
    b = F.when(F.col("value") < 10, "<10").when(F.col("value") < 50, "10-49").when(F.col("value") < 100, "50-99").otherwise(">=100")
    return table(spark, d, "events").where("value is not null").groupBy("event_type", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("user_id") % 2 == 0).alias("hits"))


@query("""select case when n_chars < 256 then '<256' when n_chars < 512 then '256-511' when n_chars < 1024 then '512-1023' when n_chars < 2048 then '1024-2047' else '>=2048' end bucket, count(*) n, count(*) filter (coalesce(int_score >= 4, false)) hits, count(*) filter (coalesce(int_score >= 4, false)) / count(*)::double rate from documents where n_chars is not null group by 1""")
def length_buckets(spark, d):
    return diagnose.length_buckets(table(spark, d, "documents"), F.col("n_chars"), [256, 512, 1024, 2048], F.coalesce(F.col("int_score") >= 4, F.lit(False)))


@query("select case when response is null or response = '' then 'empty' when position('<think>' in response) = 0 then 'no_think' when position('<response>' in response) = 0 then 'no_response' else 'formed' end \"mode\", count(*) n, count(*) / (sum(count(*)) over ())::double share from outputs group by 1")
def failure_modes(spark, d):
    r = F.col("response")
    return diagnose.failure_modes(table(spark, d, "outputs"), [("empty", r.isNull() | (r == "")), ("no_think", ~r.contains("<think>")), ("no_response", ~r.contains("<response>"))], "formed")


# Aggregates


@query("select event_type, count(*) filter (value > 50)::bigint hits, count(*) n, case when count(*) = 0 then 0 else greatest(0, (hits / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) end low, case when count(*) = 0 then 0 else least(1, (hits / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) end high from events group by 1")
def wilson(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", stats.wilson(F.col("hits"), F.col("n"))).select("event_type", "hits", "n", "w.low", "w.high")


@query(f"select {_key('source')} source, sum(strlen(text))::bigint bytes, sum(len(regexp_extract_all(text, '\\S+')))::bigint tokens, sum(strlen(text))::double / nullif(sum(len(regexp_extract_all(text, '\\S+'))), 0) bytes_per_token from documents group by 1")
def bytes_per_token(spark, d):
    g = table(spark, d, "documents").groupBy(key(F.col("source")).alias("source")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("tokens"))
    return g.withColumn("bytes_per_token", F.try_divide(F.col("bytes").cast("double"), F.col("tokens")))


@query("select event_type, list_sort(list(value))[(count(value) // 2 + 1)::bigint] upper_median, max(value) largest, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 wall_seconds from events group by 1")
def upper_median_wallclock(spark, d):
    wall = F.floor((F.unix_micros(F.max(F.to_timestamp("ts"))) - F.unix_micros(F.min(F.to_timestamp("ts")))) / 1000000)
    return table(spark, d, "events").groupBy("event_type").agg(stats.upper_median(F.col("value")).alias("upper_median"), F.max("value").alias("largest"), wall.alias("wall_seconds"))


@query("""with v as (select label, sqrt(list_sum([x::double * x::double for x in embedding])) n from embeddings) select label, count(*) n, round(min(n), 6) smallest, round(max(n), 6) largest, round(median(n), 6) middle from v group by label""")
def vector_norms(spark, d):
    v = table(spark, d, "embeddings").select("label", stats.vector_norm(F.col("embedding")).alias("v"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("smallest"), F.round(F.max("v"), 6).alias("largest"), F.round(F.median("v"), 6).alias("middle"))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) mean_loss, round(exp(least(sum(l_discount * l_quantity) / sum(l_quantity), 30)), 9) perplexity from lineitem where l_quantity > 0 group by 1")
def weighted_loss(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("m"))
    return g.select("l_returnflag", F.round("m", 9).alias("mean_loss"), F.round(stats.perplexity(F.col("m")), 9).alias("perplexity"))


@query(f"""select {_key('category')} category, {_key('subtype')} subtype, count(*) planned, count(distinct seed_topic) seeds, count(distinct seed_topic)::double / count(*) yield from requests group by all""")
def seed_yield(spark, d):
    r = table(spark, d, "requests").groupBy(key(F.col("category")).alias("category"), key(F.col("subtype")).alias("subtype"))
    return r.agg(F.count(F.lit(1)).alias("planned"), F.countDistinct("seed_topic").alias("seeds")).withColumn("yield", F.col("seeds") / F.col("planned"))


@query(f"""with c as (select {_key('category')} category, {_key('subtype')} subtype, count(*) planned, count(distinct seed_topic) seeds from requests group by all)
select cap, sum(least(planned, cap * seeds))::bigint kept from c, (select unnest([1, 2, 5, 10]) cap) group by cap""")
def cap_projection(spark, d):
    caps = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 5, 10)])).alias("cap")
    return seed_yield(spark, d).select("planned", "seeds", caps).groupBy(F.col("cap").cast("int").alias("cap")).agg(F.sum(F.least("planned", F.col("cap") * F.col("seeds"))).alias("kept"))


@query("select event_type, count(*) n, count(distinct user_id) users from events group by grouping sets ((event_type), ())")
def preference_tally(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


# Ordered rows


@query("select event_id from (select event_id, row_number() over (partition by event_type, user_id order by ts, event_id) r, 1 + user_id % 3 c from events) where r <= c")
def cap_per_cell(spark, d):
    return order.cap_per_cell(table(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"], 1 + F.col("user_id") % 3, most=3).select("event_id")


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by ts, event_id) r from events) where r <= 12")
def first_n_per_group(spark, d):
    return order.first_n(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 12).select("event_id", "event_type")


@query("select event_id, event_id % 5 outer_no, event_id // 5 % 7 inner_no from events")
def round_robin(spark, d):
    return order.round_robin(table(spark, d, "events").select("event_id"), "event_id", 5, 7)


@query("""with e as (select event_id, event_type, row_number() over (partition by event_type order by event_id) r, min(event_id) over (partition by event_type) f from events) select event_id, event_type from e order by r, f limit 50""")
def spread_over_categories(spark, d):
    return order.spread(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 50)


@query("select event_id, value > 50 flag from (select *, row_number() over (partition by value > 50 order by event_id) r from events where value is not null) where r <= 100")
def balanced_halves(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") > 50).alias("flag"))
    return order.balanced_halves(e, "flag", ["event_id"], 200)


@query("""select event_id, sum(case when f then 1 else 0 end) over (order by event_id)::bigint distinct_so_far from (select event_id, row_number() over (partition by user_id, event_type order by event_id) = 1 f from events)""")
def running_distinct(spark, d):
    return order.running_distinct(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id", "distinct_so_far")


@query()
def ema(spark, d):
    """A moving average of values by user."""
    e = order.ema(table(spark, d, "events"), "user_id", "event_id", "value")
    return e.withColumn("ema", F.round(F.col("ema") * 1e9) / 1e9)  # in doubles, as in DuckDB: the first averages often end in half of the last digit


@query("select user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) step_us from events")
def step_times(spark, d):
    us = F.unix_micros(F.to_timestamp("ts"))
    return table(spark, d, "events").select("user_id", "event_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("step_us"))


@query("select s.step, s.step > 900 or exists (select 1 from range(1, 11) t(k) where abs(s.step - 1000 * k / 10) < 25) kept from (select distinct event_id % 1000 step from events where event_id % 1000 % 20 = 0) s")
def retention(spark, d):
    c = table(spark, d, "events").select((F.col("event_id") % 1000).alias("step")).where("step % 20 = 0").distinct()
    return diagnose.retained(c, "step", 4, 25, 1000)


@query()
def shuffled_windows(spark, d):
    """Documents in a hash order, numbered without a global sort; the second half of them."""
    docs = table(spark, d, "documents").select("doc_id")
    half = docs.count() // 2
    return readers.window_scan(docs, "doc_id", half, 7)


# Rendering, sampling, whole flows


@query("""select id, loaded_utc, strlen('<|system|>' || chr(10) || coalesce(system_prompt, '') || coalesce(chr(10) || '<state>' || state || '</state>', '') || chr(10))
+ list_sum(list_transform(turns, lambda t: strlen('<|' || t.role || '|>' || chr(10) || case when t.role = 'assistant' then '<think>' || coalesce(t.think, '') || '</think><response>' || coalesce(t.calls, '') || '</response>' else coalesce(t.text, t.result, '') end || chr(10))))::bigint n from examples""")
def rendered_sizes(spark, d):
    parts = render.segments(F.col("turns"), F.col("system_prompt"), F.col("state"))
    return table(spark, d, "examples").select("id", "loaded_utc", F.octet_length(render.joined(parts)).cast("bigint").alias("n"))


@query("select id, loaded_utc, 'Tools: ' || list_aggregate(tools, 'string_agg', ',') || chr(10) || chr(10) || 'Query: ' || seed_topic || chr(10) || chr(10) || 'Calls: ' || list_aggregate(requires, 'string_agg', ',') doc from requests where seed_topic is not null and len(requires) > 0 and len(tools) > 0")
def call_documents(spark, d):
    r = table(spark, d, "requests").where("seed_topic is not null and size(requires) > 0 and size(tools) > 0")
    return r.select("id", "loaded_utc", render.call_document(F.col("seed_topic"), F.array_join("tools", ","), F.array_join("requires", ",")).alias("doc"))


@query("""select id, loaded_utc, case when len(m) > 0 then list_aggregate(list_transform(range(1, len(m) + 1), lambda i: ' ' || i || '. ' || m[i]), 'string_agg', chr(10)) else '' end block from (select id, loaded_utc, from_json(json_extract(memory, '$.recent'), '["VARCHAR"]') m from requests where memory is not null)""")
def memory_blocks(spark, d):
    r = table(spark, d, "requests").where("memory is not null")
    return r.select("id", "loaded_utc", render.memory_block(F.from_json(F.get_json_object("memory", "$.recent"), "array<string>")).alias("block"))


@query()
def prompts(spark, d):
    """What a model is given of every example: the document before the first scored segment."""
    parts = render.segments(F.col("turns"), F.col("system_prompt"), F.col("state"))
    return table(spark, d, "examples").select("id", "loaded_utc", render.prompt(parts).alias("prompt"))


@query()
def rebalanced(spark, d):
    """At most 200 requests of every subtype, paired ones all."""
    r = table(spark, d, "requests").select("id", "loaded_utc", key(F.col("subtype")).alias("subtype"), "pair_id")
    return order.rebalance(r, ["subtype"], F.concat("id", F.col("loaded_utc").cast("string")), 200, F.col("pair_id").isNotNull())


@query()
def sampled_groups(spark, d):
    """Of every category whole groups of outputs until 40 rows are there."""
    o = table(spark, d, "outputs").select("output_id", key(F.col("category")).alias("category"), F.coalesce(key(F.col("group_key")), F.col("output_id").cast("string")).alias("g"))
    return order.sample_groups(o, ["category"], "g", 40)


@query(f"""with {_LAST}, m as (select judge, run_label, sum(score)::bigint s, count(*) n from o where score >= 0 group by all)
select judge, arg_min(s, run_label) "first", arg_max(s, run_label) "last", arg_max(s, run_label) - arg_min(s, run_label) delta from m group by judge""")
def first_to_last(spark, d):
    m = _scored(spark, d).where("score >= 0").groupBy("judge", "run_label").agg(F.sum("score").alias("s"))
    return order.first_to_last(m, ["judge"], "run_label", "s")


@query(f"""with {_LAST}, a as (select category, judge, sum(score)::bigint s, count(*) n from o where score >= 0 and category is not null group by all)
select x.category, x.s::double / x.n - y.s::double / y.n gap from a x join a y using (category) where x.judge = 'judge_a' and y.judge = 'judge_b'""")
def judge_gap(spark, d):
    a = _scored(spark, d).where("score >= 0 and category is not null").groupBy("category").pivot("judge", ["judge_a", "judge_b"]).agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return a.where("judge_a_n is not null and judge_b_n is not null").select("category", (F.col("judge_a_s").cast("double") / F.col("judge_a_n") - F.col("judge_b_s").cast("double") / F.col("judge_b_n")).alias("gap"))


@query("""with e as (select event_id, case when row_number() over (partition by user_id order by event_id) = 1 then 1 else 0 end f from events), c as (select event_id, sum(f) over (order by event_id) s from e)
select min(event_id) event_id, (select max(s)::bigint from c) most from c where s >= 0.9 * (select max(s) from c)""")
def smallest_plan_reaching(spark, d):
    c = order.running_distinct(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id")
    return order.smallest_reaching(c.select("event_id", "distinct_so_far"), "event_id", "distinct_so_far", 0.9)


@query()
def pretraining_corpus(spark, d):
    """Windows of the pretraining flow for every recipe, budgets in bytes derived from the documents. A short source is used up to its epochs, the others keep their budgets."""
    docs = table(spark, d, "documents").withColumn("source", key(F.col("source")))
    b = corpus.recipe_budgets(docs, table(spark, d, "data_config"))
    return corpus.pretraining(docs.where("source is not null"), b, corpus.CorpusConfig(mode="use_all")).windows


@query()
def training_windows(spark, d):
    """Packed windows of the training flow."""
    e = readers.last_wins(table(spark, d, "examples"), ["id"], "loaded_utc").withColumn("g", key(F.col("group_key")))
    return corpus.training(e, "g", 4096).packed


@query()
def evaluation_cells(spark, d):
    """The cells of the evaluation flow."""
    o = readers.last_wins(table(spark, d, "outputs"), ["output_id"], "loaded_utc").withColumns({c: key(F.col(c)) for c in ("category", "subtype", "group_key")})
    e = table(spark, d, "examples").select("id", key(F.col("category")).alias("category"), key(F.col("subtype")).alias("subtype")).distinct()
    return corpus.evaluation(o, e)["cells"]


@query("""select window_start, event_type, count(*) n from (select event_type, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') window_start from events) group by all""")
def hourly_events(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").alias("window_start"), "event_type", "n")


from millrace import queries_reports as _reports  # noqa: E402, F401  registers its queries
