"""More SQL for the core queries, and queries that say what must hold of results that depend on hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import queries as q
from millrace.functions import jsonx, render, text
from millrace.functions.names import key, lang
from millrace.operators import checks, diagnose, mixture, order, pack, pairs, plan
from millrace.operators.components import connected_components
from millrace.queries import _key, query
from millrace.sources.tables import table
from millrace.workspace import materialise


def _between(text: str, tag: str) -> str:
    """What stands between a tag and its end, stripped, or null."""
    rest = f"substr({text}, strpos({text}, '<{tag}>') + {len(tag) + 2})"
    return f"(case when strpos({text}, '<{tag}>') > 0 and strpos({rest}, '</{tag}>') > 0 then regexp_replace(substr({rest}, 1, strpos({rest}, '</{tag}>') - 1), '^\\s+|\\s+$', '', 'g') end)"


def _list(text: str) -> str:
    """A list of calls out of JSON text: a list of objects or one object, else null."""
    parts = f"(case when json_valid({text}) then case json_type({text}::json) when 'ARRAY' then json_extract({text}::json, '$[*]') when 'OBJECT' then [{text}::json] end end)"
    return f"(case when len(list_filter({parts}, lambda x: json_type(x) <> 'OBJECT')) = 0 then {parts} end)"


def _signature(call: str) -> str:
    at = f"json_extract({call}, '$.arguments.\"' || k || '\"')"
    flat = f"case json_type({at}) when 'VARCHAR' then trim({at} ->> '$') when 'BOOLEAN' then 'bool ' || upper(({at} ->> '$')[1]) || ({at} ->> '$')[2:] when 'NULL' then 'null' else (({at} ->> '$')::double)::varchar end"
    named = f"list_filter(list_sort(json_keys({call}, '$.arguments')), lambda k: not (({call} ->> '$.name') = 'answer' and k = 'text'))"
    return f"(coalesce({call} ->> '$.name', 'None') || coalesce(array_to_string(list_transform({named}, lambda k: ' ' || k || ' ' || {flat}), ''), ''))"


GRADED = f"""
last as (select * exclude (rn) from (select *, row_number() over (partition by output_id order by loaded_utc desc nulls last) rn from outputs) where rn = 1),
read as (select output_id, {_key('category')} category, {_key('subtype')} subtype, {_key('group_key')} g, response, {_between('response', 'think')} th, {_list(_between('response', 'response'))} calls, {_list('expected')} want from last),
graded as (select *, coalesce(calls[1] ->> '$.name', case when calls[1] is not null then 'None' end) got_name, coalesce(want[1] ->> '$.name', case when want[1] is not null then 'None' end) want_name,
case when th is null then 'no_think' when length(th) < 15 then 'short_think' when calls is null then 'no_response' when len(calls) = 0 then 'empty_calls' when len(list_filter(calls, lambda c: coalesce(c ->> '$.name', 'None') = 'None')) > 0 then 'bad_shape' end fault,
case when len(calls) > 0 then {_signature('calls[1]')} end got, case when len(want) > 0 then {_signature('want[1]')} end wanted from read),
marked as (select *, fault is null and coalesce(got = wanted, false) correct from graded)"""

FAULTS = f"""
cat as (select id, loaded_utc, {_key('category')} category, turns, tools, state, memory from examples),
turn as (select id, loaded_utc, tools, unnest(list_filter(turns, lambda t: t.role = 'assistant')) t, generate_subscripts(list_filter(turns, lambda t: t.role = 'assistant'), 1) i from cat),
offer as (select id, loaded_utc, unnest(json_extract(tools, '$[*]')) o from (select distinct id, loaded_utc, tools from cat)),
tool as (select id, loaded_utc, o ->> '$.name' n, from_json(o -> '$.parameters', '["VARCHAR"]') p from offer union all select distinct id, loaded_utc, 'answer', ['text'] from cat),
call as (select id, loaded_utc, i, unnest({_list('t.calls')}) c, generate_subscripts({_list('t.calls')}, 1) j from turn),
wrong as (select call.id, call.loaded_utc, i, j, case when json_type(c -> '$.name') is distinct from 'VARCHAR' or coalesce(json_type(c -> '$.arguments'), 'OBJECT') <> 'OBJECT' then 'bad_shape' when tool.n is null then 'undefined_tool'
  when len(list_filter(coalesce(json_keys(c, '$.arguments'), []), lambda k: not list_contains(p, k))) > 0 then 'unknown_arg' end f from call left join tool on tool.id = call.id and tool.loaded_utc is not distinct from call.loaded_utc and n = c ->> '$.name'),
per_turn as (select id, loaded_utc, i, coalesce(case when length(regexp_replace(coalesce(t.think, ''), '^\\s+|\\s+$', '', 'g')) < 15 then 'empty_think' when regexp_matches(t.think, '(?i)<\\s*/?\\s*(think|response|tool|\\|im_)') then 'think_leaked_markup' end,
  case when coalesce(len({_list('t.calls')}), 0) = 0 then 'no_calls' end, (select arg_min(f, j) from wrong where wrong.id = turn.id and wrong.loaded_utc is not distinct from turn.loaded_utc and wrong.i = turn.i and f is not null)) f from turn),
early as (select id, loaded_utc, arg_min(f, i) f from per_turn where f is not null group by all),
shape as (select *, list_filter([x.role for x in turns], lambda x: x <> 'user') r, len(list_filter(turns, lambda t: t.role = 'assistant')) n, category = 'state_memory_conflict' paired,
  coalesce(json_array_length(memory, '$.recent'), 0) + coalesce(json_array_length(memory, '$.last_results'), 0) > 0 populated from cat),
faults as (select shape.id, shape.loaded_utc, category, case when len(r) % 2 = 0 or len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> case when i % 2 = 1 then 'assistant' else 'tool' end)) > 0 then 'bad_turn_order'
  when n not between 1 and 5 then 'turn_count_out_of_bounds' when f is not null then f when paired and state is null then 'state_missing' when not paired and state is not null then 'state_unexpected'
  when paired and not populated then 'memory_missing' when not paired and populated then 'memory_unexpected' end fault from shape left join early on early.id = shape.id and early.loaded_utc is not distinct from shape.loaded_utc)"""

_TREE = """select pair_id, side, j.key, j.type, j.atom, j.fullkey, j.path, case j.type when 'ARRAY' then json_array_length(state, j.fullkey) end n from (select pair_id, 'a' side, a state from p union all select pair_id, 'b', b from p) s, json_tree(s.state) j"""

_PAIRS_SQL = """p as (select pair_id, arg_max(state, loaded_utc) filter (branch = 'a') a, arg_max(state, loaded_utc) filter (branch = 'b') b, (arg_max({'m': memory}, loaded_utc) filter (branch = 'a')).m ma, (arg_max({'m': memory}, loaded_utc) filter (branch = 'b')).m mb, (arg_max({'r': request}, loaded_utc) filter (branch = 'a')).r ra, (arg_max({'r': request}, loaded_utc) filter (branch = 'b')).r rb, count(*) filter (branch = 'a') na, count(*) filter (branch = 'b') nb from requests where pair_id is not null group by 1 having na > 0 and nb > 0)"""
_DIFFS_OF = rf"""t as ({_TREE}), m as (select coalesce(x.pair_id, y.pair_id) pair_id, coalesce(x.fullkey, y.fullkey) fullkey, coalesce(x.path, y.path) path, x.type is not null and y.type is not null and ((x.type = 'OBJECT' and y.type = 'OBJECT') or (x.type = 'ARRAY' and y.type = 'ARRAY' and x.n = y.n)) is_open,
  x.type is not null and y.type is not null and x.type not in ('OBJECT', 'ARRAY') and x.type = y.type and x.atom::varchar = y.atom::varchar same from (select * from t where side = 'a') x full join (select * from t where side = 'b') y on x.pair_id = y.pair_id and x.fullkey = y.fullkey),
d as (select m.pair_id, replace(replace(regexp_replace(substr(m.fullkey, 2), '\[(\d+)\]', '.\1', 'g'), '"', ''), '.', '/') pointer from m left join m u on u.pair_id = m.pair_id and u.fullkey = m.path where not m.is_open and not coalesce(m.same, false) and (m.fullkey = '$' or u.is_open))
select pair_id, coalesce(list_sort(list(pointer) filter (pointer is not null)), []) pointers from p left join d using (pair_id) group by 1"""
_DIFFS = f"with {_DIFFS_OF}"

q._SQL |= {
    "state_schema": r"""with s as (select row_number() over () r, state from requests where state is not null and json_valid(state)),
l as (select distinct r, replace(replace(regexp_replace(substr(j.fullkey, 2), '\[\d+\]', '.#', 'g'), '"', ''), '.', '/') pointer from s, json_tree(s.state) j where j.type not in ('OBJECT', 'ARRAY') or j.value::varchar in ('{}', '[]'))
select pointer, count(*) n from l group by 1""",
    "branch_state_diff": f"with {_PAIRS_SQL}, {_DIFFS_OF}",
    "canonical_replies": rf"""with r as (select output_id, loaded_utc, {_list(_between('response', 'response'))} calls, regexp_extract(response, '\[.*\]', 0, 's') f from outputs)
select output_id, loaded_utc, case when calls is not null then list_transform(calls, lambda c: {_signature('c')}) end calls, case when f <> '' and json_valid(f) and json_type(f::json, '$[0].name') is not null then f end "first" from r""",
    "graded_replies": f"with {GRADED} select output_id, fault, correct from marked",
    "category_rates": f"""with {GRADED}, c as (select category, count(*) n, count(*) filter (fault is null) well_formed, count(*) filter (correct) correct from marked group by category union all select null, count(*), count(*) filter (fault is null), count(*) filter (correct) from marked)
select *, well_formed / n::double well_formed_rate, correct / n::double correct_rate from c where n > 0""",
    "reply_faults": f"with {GRADED} select fault, count(*) n, count(*) / (sum(count(*)) over ())::double share from marked group by fault",
    "reply_confusion": f"""with {GRADED} select want_name want, got_name got, count(*) n, want_name is not distinct from got_name correct_name from marked where fault is null group by all order by count(*) desc, min(output_id), want_name, got_name limit 25""",
    "reply_default_call": f"""with {GRADED} select got_name got, count(*) n, count(*) / (sum(count(*)) over ())::double share from marked where fault is null and not correct group by got_name order by count(*) desc, min(output_id) limit 12""",
    "reply_pair_outcomes": f"""with {GRADED}, p as (select g, count(*) n, count(*) filter (correct) c from marked where g is not null group by g)
select count(*) filter (n = 2) pairs, count(*) filter (n <> 2) dropped_incomplete, count(*) filter (n = 2 and c = 2) "both", count(*) filter (n = 2 and c = 1) one, count(*) filter (n = 2 and c = 0) neither, coalesce(count(*) filter (n = 2 and c = 2)::double / nullif(count(*) filter (n = 2), 0), 0) grounded_rate from p""",
    "evaluation_cells": f"""with {GRADED}, t as (select category, subtype, count(*) n from (select distinct id, {_key('category')} category, {_key('subtype')} subtype from examples) group by all),
v as (select category, subtype, count(*) n, count(*) filter (fault is null) w, count(*) filter (correct) c from marked group by all)
select coalesce(t.category, v.category) category, coalesce(t.subtype, v.subtype) subtype, coalesce(t.n, 0) n_train, coalesce(t.n, 0)::double / sum(t.n) over () train_share, coalesce(v.n, 0) n_val, w::double / v.n well_formed_rate, c::double / v.n correct_rate, 0::bigint n_train_graded, null::double train_correct_rate, coalesce(v.n, 0) < 20 thin
from t full join v on t.category = v.category and t.subtype = v.subtype""",
    "think_coupling": f"""with {GRADED}, tools as (select distinct unnest(tools) t from requests), m as (select got_name, (select list(t) from tools where regexp_matches(th, '\\b' || t || '\\b')) named from marked where fault is null)
select count(*) considered, count(*) filter (named[1] = got_name) agreed, count(*) filter (named[1] <> got_name) decoupled, count(*) filter (named[1] <> got_name)::double / nullif(count(*), 0) decoupled_rate from m where len(named) = 1""",
    "record_faults": f"with {FAULTS} select * from faults",
    "reject_tally": f"with {FAULTS} select category, fault, count(*) n, count(*) / (sum(count(*)) over (partition by category))::double share from faults group by category, fault",
    "prompts": """select id, loaded_utc, '<|system|>' || chr(10) || coalesce(system_prompt, '') || coalesce(chr(10) || '<state>' || state || '</state>', '') || chr(10) || coalesce(array_to_string(list_transform(case when list_position([t.role for t in turns], 'assistant') > 0 then turns[1:list_position([t.role for t in turns], 'assistant') - 1] else turns end,
  lambda t: '<|' || t.role || '|>' || chr(10) || coalesce(t.text, t.result, '') || chr(10)), ''), '') prompt from examples""",
    "ema": """with recursive r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id, value) n from events where value is not null),
e as (select user_id, event_id, value, n, value::double ema from r where n = 1 union all select r.user_id, r.event_id, r.value, r.n, e.ema + 0.05 * (r.value - e.ema) from e join r on r.user_id = e.user_id and r.n = e.n + 1)
select user_id, event_id, value, round(ema, 9) ema from e""",
    "pretraining_corpus": f"""with t as (select sum(strlen(text)) total from documents), d as (select {_key('source')} source, doc_id, strlen(text) n from documents where int_score >= 4 and length(text) > 0),
h as (select source, sum(n)::bigint have from d where source is not null group by 1), p as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint f from d where source is not null),
b as (select config_id, source_key source, floor(budget_tokens::double / sum(budget_tokens) over (partition by config_id) * mix_ratio * total)::bigint budget, xlam_epochs from data_config, t),
a as (select config_id, b.source, have, least(have * xlam_epochs, budget) // 4096 * 4096 take from b join h using (source)),
u as (select config_id, source, doc_id, n, f, have, take, unnest(range(0, (take - 1 - f) // have + 1)) epoch from p join a using (source) where f < take),
w as (select config_id, source, epoch, doc_id, epoch * have + f pos, least(n, take - (epoch * have + f)) used from u)
select config_id, source, epoch, doc_id, used::bigint used, window_id, greatest(pos, window_id * 4096) - pos start_in_row, least(pos + used, (window_id + 1) * 4096) - greatest(pos, window_id * 4096) taken from (select *, unnest(range(pos // 4096, (pos + used - 1) // 4096 + 1)) window_id from w)""",
}


# What must hold


@query(f"with w as (select {_key('source')} source, (sum(n_chars) // 4096)::bigint windows from documents group by 1) select source, windows, true holds from w where source is not null and windows > 0")
def interleave_holds(spark, d):
    """Every window has a slot and every slot a window; in each tenth of the slots a source has its share, within a tenth and ten."""
    s = q.interleave_slots(spark, d).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("source")))
    n = s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).select("n", ((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("whole"))
    tenth = s.crossJoin(F.broadcast(n)).groupBy("source", F.floor(F.col("slot") * 10 / F.col("n")).alias("tenth")).agg(F.count(F.lit(1)).alias("here"), F.max("total").alias("windows"), F.countDistinct("window_id").alias("ids"), F.max("window_id").alias("last"), F.bool_and("whole").alias("whole"))
    even = F.abs(F.col("here") - F.col("windows") / 10) <= F.col("windows") / 100 + 4 * F.sqrt(F.col("windows") / 10) + 1
    return tenth.groupBy("source").agg(F.max("windows").alias("windows"), F.bool_and(even & F.col("whole") & (F.col("last") < F.col("windows"))).alias("holds"))


_WORDS = "sum(len(regexp_extract_all(coalesce(t.text, t.think, ''), '\\S+')))"
_ITEMS = f"select id, max(n) n from (select id, loaded_utc, {_WORDS}::bigint n from (select id, loaded_utc, unnest(turns) t from examples) group by all) group by id"


@query(f"with i as ({_ITEMS}) select count(*) filter (n <= 1024) items, sum(n) filter (n <= 1024)::bigint tokens, count(*) filter (n > 1024) refused, true holds from i")
def binpack_holds(spark, d):
    """Every item that fits is in one window, none over its size, and windows are filled to nine tenths and more."""
    p = q.binpack(spark, d)
    w = p.groupBy("pack_group", "window_no").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("k"), F.countDistinct("position").alias("places"), F.max("position").alias("last"))
    w = w.agg(F.sum("load").alias("tokens"), F.sum("k").alias("items"), F.bool_and((F.col("load") <= 1024) & (F.col("places") == F.col("k")) & (F.col("last") == F.col("k") - 1)).alias("ok"), F.avg("load").alias("fill"))
    ids = p.agg(F.countDistinct("id").alias("ids"))
    refused = pack.refused(q.binpack_items(spark, d), "id", "n", 1024).agg(F.count(F.lit(1)).alias("refused"))
    return w.crossJoin(ids).crossJoin(refused).select("items", "tokens", "refused", (F.col("ok") & (F.col("ids") == F.col("items")) & (F.col("fill") >= 0.9 * 1024)).alias("holds"))  # one row each


def _norm(c: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), ' ')"


@query(f"with d as (select doc_id, {_norm('text')} t from documents) select t = '' blank, count(*) documents, count(distinct t) texts, true holds from d group by 1")
def minhash_holds(spark, d):
    """Of documents with the same words the first at most is kept, the others never, and of those that share no five words with another all are kept."""
    words = F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), " ")
    docs = table(spark, d, "documents").select("doc_id", words.alias("t")).join(q.minhash_dedup(spark, d), "doc_id")
    g = docs.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"), F.min("doc_id").alias("first"), F.min(F.when(F.col("kept"), F.col("doc_id"))).alias("kept"))
    ok = (F.col("k") <= 1) & (F.col("kept").isNull() | (F.col("kept") == F.col("first"))) & ((F.col("t") != "") | (F.col("k") == 1))
    return g.groupBy((F.col("t") == "").alias("blank")).agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("texts"), F.bool_and(ok).alias("holds"))


@query(f"with o as (select id, any_value({_key('group_key')}) g from examples group by id) select g is null single, count(*) examples, count(distinct coalesce(g, id)) groups, true holds from o group by 1")
def minhash_group_holds(spark, d):
    """A group is kept or dropped whole, and at least one example of every distinct text stays."""
    e = table(spark, d, "examples").groupBy("id").agg(F.max(key(F.col("group_key"))).alias("g")).join(q.minhash_group_dedup(spark, d), "id")
    g = e.groupBy(F.col("g").isNull().alias("single"), F.coalesce("g", "id").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kept").alias("k"))
    return g.groupBy("single").agg(F.sum("n").alias("examples"), F.count(F.lit(1)).alias("groups"), F.bool_and(F.col("k") == 1).alias("holds"))


@query(f"with e as (select id, min(epoch_us(loaded_utc) // 1000000) loaded from examples group by id), m as (select floor(avg(epoch_us(loaded_utc) // 1000000)) mean from examples) select (select count(distinct id) from examples, m where epoch_us(loaded_utc) // 1000000 > mean and id not in (select id from examples, m where epoch_us(loaded_utc) // 1000000 <= mean)) candidates, true holds")
def top_up_holds(spark, d):
    """Additions are ids that are new, each once; some are left out as near-duplicates."""
    e = table(spark, d, "examples").select("id", F.unix_seconds(F.to_timestamp("loaded_utc")).alias("at"))
    e = e.crossJoin(F.broadcast(e.agg(F.floor(F.avg("at")).alias("mean"))))
    fresh = e.where("at > mean").select("id").distinct().join(e.where("at is null or at <= mean").select("id"), "id", "left_anti")
    added = q.top_up_deduped(spark, d)
    a = added.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).crossJoin(added.join(fresh, "id", "left_anti").agg(F.count(F.lit(1)).alias("stray")))
    return fresh.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(a).select("candidates", ((F.col("n") == F.col("ids")) & (F.col("stray") == 0) & (F.col("n") <= F.col("candidates"))).alias("holds"))


@query(f"with r as (select {_key('subtype')} subtype, pair_id is not null paired, count(*) n from requests group by all) select subtype, sum(case when paired then n else least(n, 200) end)::bigint n from r group by 1")
def rebalanced_counts(spark, d):
    """Requests of every subtype after rebalancing."""
    return q.rebalanced(spark, d).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


@query(f"with o as (select {_key('category')} category, count(*) n from outputs group by 1) select category, n, true holds from o")
def sampled_groups_holds(spark, d):
    """Sampled groups are whole, and a category without its last group has fewer than 40 rows."""
    o = table(spark, d, "outputs").select("output_id", key(F.col("category")).alias("category"), F.coalesce(key(F.col("group_key")), F.col("output_id").cast("string")).alias("g"))
    all_of = o.groupBy("category", "g").agg(F.count(F.lit(1)).alias("n"))
    got = q.sampled_groups(spark, d).groupBy(F.col("category").alias("c"), F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("k"))
    j = all_of.join(got, F.col("category").eqNullSafe(F.col("c")) & (F.col("g") == F.col("h")), "left")
    c = j.groupBy("category").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("k") == F.col("n"), F.lit(True))).alias("whole"), F.sum("k").alias("rows"), F.max("k").alias("largest"))
    return c.select("category", "n", (F.col("whole") & ((F.col("rows") >= 40) | (F.col("rows") == F.col("n"))) & (F.col("rows") - F.col("largest") < 40)).alias("holds"))


@query("select count(*) - count(*) // 2 n, true holds from documents")
def shuffled_holds(spark, d):
    """The second half of a hash order: every place from the middle on once, every document at most once."""
    s = q.shuffled_windows(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("place").alias("places"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    return s.select("n", ((F.col("ids") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("hi") - F.col("lo") == F.col("n") - 1)).alias("holds"))


@query("select split, true holds from (values ('train'), ('val')) t(split)")
def training_holds(spark, d):
    """Packed windows of the training flow: none over its size, every example once and in one split, groups not divided."""
    p = q.training_windows(spark, d)
    e = table(spark, d, "examples").groupBy("id").agg(F.max(key(F.col("group_key"))).alias("g"))
    load = p.groupBy("split", "pack_group", "window_no").agg(F.sum("n").alias("load")).groupBy("split").agg(F.max("load").alias("most"))
    per = p.join(e, "id").withColumn("g", F.coalesce("g", "id"))
    apart = per.groupBy("g").agg(F.countDistinct("split").alias("s")).agg(F.max("s").alias("s"))
    ids = p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
    return load.join(ids, "split").crossJoin(apart).select("split", ((F.col("most") <= 4096) & (F.col("n") == F.col("ids")) & (F.col("s") == 1)).alias("holds"))


@query(f"select {q._lang('lang')} lang, source, count(*) n, sum(n_chars)::bigint chars from documents where {q._lang('lang')} in ('de', 'fr', 'ja') group by all")
def partition_scan_folders(spark, d):
    """Documents of three languages out of a table with a folder for each: folders of others are not read."""
    docs = table(spark, d, "documents").select(F.coalesce(lang(F.col("lang")), F.lit("none")).alias("lang"), "source", "n_chars")
    laid = materialise(docs, "by-language", by="lang").where(F.col("lang").isin("de", "fr", "ja"))
    return laid.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# Plans


_PLANNED = """p as (select category, paired, domains, subtypes, round_even(30000 * share, 0)::bigint n0 from category_specs), e as (select *, case when paired then n0 + n0 % 2 else n0 end n1 from p),
c as (select *, (n1 + case when category = (select arg_max(category, n1) from e where not paired) then 30000 - (select sum(n1) from e) else 0 end)::bigint planned from e)"""


def _planned(spark, d):
    specs = table(spark, d, "category_specs")
    plan.check_shares({r[0]: r[1] for r in specs.select("category", "share").collect()}, [r[0] for r in specs.select("category").collect()])
    return specs.select("category", "domains", "subtypes").join(mixture.plan_counts(specs, 30_000), "category")


@query(f"""with {_PLANNED}, i as (select *, unnest(range(planned)) i from c where not paired)
select category, i, category || '-' || lpad(i::varchar, 9, '0') id, domains[i % len(domains) + 1] "domain", subtypes[i // len(domains) % len(subtypes) + 1] subtype from i where i // (len(domains) * len(subtypes)) < 900""")
def request_plan(spark, d):
    """The plan of the unpaired categories, at most 900 requests of each domain and subtype."""
    return plan.unpaired(_planned(spark, d).where("not paired"), 900)


@query(f"""with {_PLANNED}, i as (select *, unnest(range(planned // 2)) i from c where paired)
select category, 'pair-' || lpad(i::varchar, 9, '0') pair_id, b branch, 'pair-' || lpad(i::varchar, 9, '0') || '-' || b id, subtypes[i % len(subtypes) + 1] subtype from i, (values ('a'), ('b')) t(b)""")
def pair_plan(spark, d):
    """The plan of the paired category."""
    return plan.paired(_planned(spark, d).where("paired"))


@query(f"""with r as (select id, len(list_distinct(requires)) k, greatest(len(list_distinct(requires)), 4) n from (select distinct id, loaded_utc, requires from requests)), m as (select (select count(*) from (select distinct unnest(tools) from requests)) pool)
select id, count(*) "rows", sum(least(n, pool))::bigint offered, true holds from r, m group by id""")
def offered_tools_holds(spark, d):
    """Four tools for every request, those it requires among them, each once, and the same for the same request."""
    r = table(spark, d, "requests").select("id", "loaded_utc", "requires").distinct()
    pool = table(spark, d, "requests").select(F.explode("tools").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("pool"))  # names of tools, a small table
    must = F.array_distinct(F.coalesce("requires", F.array()))
    r = r.crossJoin(F.broadcast(pool)).withColumn("must", must).withColumn("got", plan.sampled_tools(F.col("pool"), F.col("id"), F.lit(4), F.col("must")))
    ok = (F.size(F.array_except("must", "got")) == 0) & (F.size(F.array_distinct("got")) == F.size("got"))
    return r.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("got")).alias("offered"), F.bool_and(ok).alias("holds"))


@query(f"""with r as (select {_key('category')} category, {_key('subtype')} subtype from requests) select category, subtype, (grouping(category) + grouping(subtype))::int "level", count(*) n, count(*)::double / (select count(*) from r) share from r group by rollup (category, subtype)""")
def plan_histogram(spark, d):
    """Requests of every category and subtype with totals."""
    return plan.histogram(table(spark, d, "requests").select(key(F.col("category")).alias("category"), key(F.col("subtype")).alias("subtype")), "category", "subtype")


@query(f"""select {_key('category')} category, count(*) planned, count(seed_topic) drawn, count(distinct seed_topic) seeds, count(seed_topic)::double / nullif(count(distinct seed_topic), 0) reuse from requests group by 1""")
def seed_reuse(spark, d):
    """How often a category's seeds are used."""
    g = table(spark, d, "requests").groupBy(key(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("planned"), F.count("seed_topic").alias("drawn"), F.countDistinct("seed_topic").alias("seeds"))
    return g.withColumn("reuse", F.try_divide(F.col("drawn").cast("double"), F.col("seeds")))


@query(f"""with s as (select {_key('source')} source_key, sum(n_chars) available from documents group by 1), t as (select sum(n_chars) total from documents), c as (select *, budget_tokens::double / sum(budget_tokens) over (partition by config_id) share from data_config)
select config_id, source_key, share, available::bigint available, case when available is null then 'missing' when available >= share * mix_ratio * total then 'ok' when available * xlam_epochs >= share * mix_ratio * total then 'repeats' else 'short' end status from c left join s using (source_key), t""")
def source_status(spark, d):
    """Budget shares of every recipe and whether its sources suffice, with or without repeats."""
    docs = table(spark, d, "documents").groupBy(key(F.col("source")).alias("source_key")).agg(F.sum("n_chars").alias("available"))
    share = F.col("budget_tokens").cast("double") / F.sum("budget_tokens").over(Window.partitionBy("config_id"))
    c = table(spark, d, "data_config").withColumn("share", share).crossJoin(F.broadcast(docs.agg(F.sum("available").alias("total"))))  # one row
    goal = F.col("share") * F.col("mix_ratio") * F.col("total")
    status = F.when(F.col("available").isNull(), "missing").when(F.col("available") >= goal, "ok").when(F.col("available") * F.col("xlam_epochs") >= goal, "repeats").otherwise("short")
    return c.join(docs, "source_key", "left").select("config_id", "source_key", "share", "available", status.alias("status"))


@query(f"""with r as (select {_key('category')} category, count(*) n, count(distinct seed_topic) * 5 ceiling from requests group by 1), t as (select sum(n) total from r where category is not null)
select category, share, coalesce(n, 0)::bigint n, coalesce(ceiling, 0)::bigint ceiling, greatest(0, coalesce(ceiling, 0) - coalesce(n, 0))::bigint headroom, coalesce(ceiling, 0) >= share * total reachable from category_specs left join r using (category), t""")
def drift_headroom(spark, d):
    """How many more requests a category's seeds allow, five of each, and whether its share can be reached."""
    r = table(spark, d, "requests").groupBy(key(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("seed_topic") * 5).alias("ceiling"))
    total = F.broadcast(r.where("category is not null").agg(F.sum("n").alias("total")))
    c = table(spark, d, "category_specs").select("category", "share").join(r, "category", "left").fillna(0, ["n", "ceiling"]).crossJoin(total)  # one row
    return c.select("category", "share", "n", "ceiling", F.greatest(F.lit(0), F.col("ceiling") - F.col("n")).alias("headroom"), (F.col("ceiling") >= F.col("share") * F.col("total")).alias("reachable"))


@query(f"""with r as (select {_key('category')} category, count(distinct id) planned from requests group by 1), e as (select {_key('category')} category, count(distinct id) kept from examples group by 1)
select category, planned, coalesce(kept, 0) kept, coalesce(kept, 0)::double / planned yield from r left join e using (category) where category is not null""")
def marginal_yield(spark, d):
    """Examples by requests of every category."""
    count = lambda t, n: table(spark, d, t).groupBy(key(F.col("category")).alias("category")).agg(F.countDistinct("id").alias(n))
    j = count("requests", "planned").where("category is not null").join(count("examples", "kept"), "category", "left").fillna(0, ["kept"])
    return j.withColumn("yield", F.col("kept").cast("double") / F.col("planned"))


# Reports on replies


def _with_calls(spark, d):
    reply = text.response(F.col("response"))
    first = lambda c: F.get(c, F.lit(0))
    return q._graded(spark, d).withColumns({"got": first(jsonx.canonical_calls(reply)), "want": first(jsonx.canonical_calls("expected")), "got_name": first(jsonx.call_names(reply)), "want_name": first(jsonx.call_names("expected")), "g": key(F.col("group_key"))})


@query(f"""with {GRADED}, a as (select count(*) n, count(got) formed, count(*) filter (got is not null and wanted is not null) known, count(*) filter (got_name = want_name) tool, count(*) filter (got = wanted) args from marked),
p as (select g, count(*) filter (got = wanted) r, min(coalesce(got, '')) lo, max(coalesce(got, '')) hi from marked where g is not null group by g having count(*) = 2)
select n, formed::double / n well_formed, tool::double / known right_tool, args::double / known right_tool_args, (select count(*) from p) pairs, (select count(*) from p where r = 2) grounded, (select count(*) from p where lo = hi) identical_pairs from a""")
def exact_metrics(spark, d):
    """What can be said of replies without a judge."""
    return diagnose.exact_metrics(_with_calls(spark, d), "got", "want", "got_name", "want_name", "g")


@query(f"""with {GRADED}, f as (select run_label, fault, count(*) k, count(*) filter (strpos(marked.response, '<think>') > 1) b from marked join last using (output_id) group by all)
select run_label, fault, sum(k) over (partition by run_label)::bigint seen, coalesce(sum(k) filter (fault is null or fault not in ('no_think', 'no_response')) over (partition by run_label), 0)::bigint parsed, coalesce(sum(k) filter (fault is null) over (partition by run_label), 0)::bigint usable, sum(b) over (partition by run_label)::bigint preamble, k from f""")
def preflight(spark, d):
    """Replies of every run seen, read, usable and with text before the first tag, and their faults."""
    p = diagnose.preflight(q._graded(spark, d), ["run_label"], "response")
    every = F.map_concat("rejects", F.map_from_arrays(F.array(F.lit("")), F.array("usable")))
    return p.select("run_label", "seen", "parsed", "usable", "preamble", F.explode(every).alias("fault", "k")).where("k > 0").withColumn("fault", F.nullif("fault", F.lit("")))


@query(f"""with {GRADED}, tools as (select distinct unnest(tools) t from requests), m as (select output_id, got_name, (select list(t) from tools where regexp_matches(th, '\\b' || t || '\\b')) named,
len(list_filter(list_transform(json_keys(want[1], '$.arguments'), lambda k: case when json_type(want[1], '$.arguments."' || k || '"') = 'VARCHAR' then want[1] ->> ('$.arguments."' || k || '"') end), lambda v: v is not null and length(v) > 2 and contains(lower(th), lower(v)))) > 0
and len(list_intersect(list_filter(list_transform(json_keys(want[1], '$.arguments'), lambda k: case when json_type(want[1], '$.arguments."' || k || '"') = 'VARCHAR' then want[1] ->> ('$.arguments."' || k || '"') end), lambda v: v is not null and length(v) > 2), list_transform(json_keys(calls[1], '$.arguments'), lambda k: calls[1] ->> ('$.arguments."' || k || '"')))) = 0 and not correct knew from marked where fault is null)
select count(*) filter (len(named) = 1) considered, count(*) filter (len(named) = 1 and named[1] = got_name) agreed, count(*) filter (len(named) = 1 and named[1] <> got_name) decoupled, count(*) filter (len(named) = 1 and named[1] <> got_name)::double / nullif(count(*) filter (len(named) = 1), 0) decoupled_rate, count(*) filter (coalesce(knew, false)) knew_but_missed from m""")
def think_call_coupling(spark, d):
    """Whether the reasoning names the tool that is called, of all tools that requests offer, and whether it names a value that the call lacks."""
    tools = table(spark, d, "requests").select(F.explode("tools").alias("t")).agg(F.collect_set("t").alias("offered"))  # names of tools, a small table
    g = q._graded(spark, d).where("fault is null").crossJoin(F.broadcast(tools))
    reply, th = text.response(F.col("response")), text.think(F.col("response"))
    want = F.filter(jsonx.string_arguments(F.col("expected")), lambda v: F.length(v) > 2)
    g = g.withColumns({"think": th, "want": want, "used": jsonx.argument_values(reply), "called": F.get(jsonx.call_names(reply), F.lit(0))})
    knew = ~F.col("correct") & F.exists("want", lambda v: F.contains(F.lower("think"), F.lower(v))) & ~F.arrays_overlap("want", "used")
    return diagnose.coupling(g, F.col("think"), F.col("offered"), F.col("called"), knew)


@query(f"""with {q._LAST}, b as (select g, avg(score) filter (judge = 'judge_a') x, avg(score) filter (judge = 'judge_b') y from o where score >= 0 and g is not null group by g)
select count(*) n, round(corr(x, y), 9) correlation, round(avg(abs(x - y)), 9) mean_difference from b where x is not null and y is not null""")
def judge_agreement(spark, d):
    """Two judges on the groups that both scored."""
    a = diagnose.agreement(q._scored(spark, d).where("g is not null"), ["g"], "judge", "score", "judge_a", "judge_b")
    return a.select("n", F.round("correlation", 9).alias("correlation"), F.round("mean_difference", 9).alias("mean_difference"))


@query("""with p as (select l_orderkey, count(*) n, count(*) filter (l_returnflag = 'R') c, max(l_linenumber::varchar) filter (l_returnflag = 'R') winner from lineitem group by 1), w as (select winner branch, count(*) wins from p where n = 2 and c = 1 group by 1)
select branch, wins, max(wins) over ()::double / sum(wins) over () skew from w""")
def branch_bias(spark, d):
    """Which of two lines of an order alone is returned: a stand-in for branches, which outputs don't name."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("branch"), (F.col("l_returnflag") == "R").alias("correct"))
    return pairs.branch_bias(lines, "l_orderkey", "branch")


@query(f"with {GRADED}, p as (select g, any_value(spec) spec, count(*) n, count(*) filter (correct) c from (select marked.*, {_key('spec_id')} spec from marked join last using (output_id)) where g is not null group by g), o as (select spec, count(*) filter (n = 2) pairs, count(*) filter (n <> 2) dropped_incomplete, count(*) filter (n = 2 and c = 2) \"both\", count(*) filter (n = 2 and c = 1) one, count(*) filter (n = 2 and c = 0) neither from (select g, n, c, s.spec from p join (select g, {_key('spec_id')} spec, count(*) k from (select {_key('group_key')} g, spec_id from last) group by all) s using (g) where s.k = p.n) group by spec) select spec, pairs, dropped_incomplete, \"both\", one, neither, coalesce(\"both\"::double / nullif(pairs, 0), 0) grounded_rate from o")
def spec_pair_outcomes(spark, d):
    """Outcomes of pairs by specification, of the groups whose outputs name one and the same."""
    g = q._graded(spark, d).select("correct", key(F.col("group_key")).alias("g"), key(F.col("spec_id")).alias("spec"))
    one = g.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("spec", F.lit(""))).alias("k")).where("k = 1").select("g")
    return pairs.outcomes(g.join(one, "g"), "g", by=["spec"])


@query(f"with {q._LAST} select judge, output_id, score from (select *, row_number() over (partition by judge order by score, output_id) r from o where score >= 0) where r <= 8")
def worst_scores(spark, d):
    """The eight worst replies by every judge."""
    return diagnose.worst(q._scored(spark, d).where("score >= 0"), ["judge"], ["score", "output_id"], 8).select("judge", "output_id", "score")


_GAPS = f"""{q._LAST}, c as (select category, subtype, count(*) filter (run_label like 'sft%') n_train_graded, count(*) filter (run_label like 'sft%' and score >= 4) tc, count(*) filter (run_label not like 'sft%') n_val, count(*) filter (run_label not like 'sft%' and score >= 4) vc from o where category is not null and subtype is not null group by all)"""


def _cells(spark, d):
    train, val = q._two_sides(spark, d)
    return diagnose.cell_report(train, val, train, ["category", "subtype"])


@query(f"with {_GAPS} select category, subtype, round(tc::double / n_train_graded - vc::double / n_val, 12) gap from c where n_train_graded >= 20 and n_val >= 20 order by tc::double / n_train_graded - vc::double / n_val desc, category, subtype limit 5")
def widest_gaps(spark, d):
    """The five cells in which training is furthest ahead."""
    return diagnose.widest_gaps(_cells(spark, d), ["category", "subtype"]).withColumn("gap", F.round("gap", 12))


@query(f"with {_GAPS} select category, subtype, n_val, vc::double / n_val correct_rate from c where n_val >= 20 order by 4, 1, 2 limit 8")
def worst_cells(spark, d):
    """The eight worst cells that aren't thin."""
    return diagnose.worst_cells(_cells(spark, d), ["category", "subtype"])


@query(f"with {q._LAST} select run_label, (coalesce(nullif(regexp_extract(run_label, '(\\d+)k$', 1), '')::bigint * 1000, nullif(regexp_extract(run_label, '(\\d+)$', 1), '')::bigint))::bigint step, count(*) n, avg(score) filter (score >= 0) mean from o group by run_label")
def labels_by_step(spark, d):
    """Runs in the order of the step that their label names."""
    part = lambda p: F.nullif(F.regexp_extract("run_label", p, 1), F.lit("")).cast("bigint")
    g = q._scored(spark, d).groupBy("run_label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("score") >= 0, F.col("score"))).alias("mean"))
    return g.withColumn("step", F.coalesce(part(r"(\d+)k$") * 1000, part(r"(\d+)$"))).orderBy("step", "run_label")


@query(f"with {GRADED} select output_id, fault, correct, score from marked join last using (output_id) where score is not null")
def verdicts_on_results(spark, d):
    """Judges' scores beside what grading says of the same replies."""
    o = table(spark, d, "outputs")
    verdict = o.where("score is not null").groupBy("output_id").agg(F.max_by("score", "loaded_utc").alias("score"))
    last = o.groupBy("output_id").agg(F.max_by(F.struct("score"), "loaded_utc").alias("s")).where("s.score is not null").select("output_id")
    return q._graded(spark, d).select("output_id", "fault", "correct").join(verdict, "output_id").join(last, "output_id")


# Records, pairs and prompts


@query(r"""with e as (select id, loaded_utc, turns, case when json_valid(memory) then from_json(json_extract(memory, '$.recent'), '["VARCHAR"]') || coalesce(from_json(json_extract(memory, '$.last_results'), '["VARCHAR"]'), []) end m from examples)
select id, loaded_utc, regexp_replace(list_filter(turns, lambda t: t.role = 'user')[1].text, '^\s+|\s+$', '', 'g') "user", list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: regexp_replace(t.think, '^\s+|\s+$', '', 'g')) thinks,
list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: t.calls) calls, list_transform(list_filter(turns, lambda t: t.role = 'tool'), lambda t: t.result) results,
case when len(m) > 0 then array_to_string(list_transform(range(1, len(m) + 1), lambda i: ' ' || i || '. ' || m[i]), chr(10)) end memory from e""")
def record_examples(spark, d):
    """Checked records as examples."""
    return table(spark, d, "examples").select("id", "loaded_utc", render.record_example(F.col("turns"), F.col("memory")).alias("e")).select("id", "loaded_utc", "e.*")


@query("""with p as (select pair_id, branch, arg_max({'s': state, 'm': memory, 'r': request}, loaded_utc) x from requests where pair_id is not null and branch in ('a', 'b') group by all)
select pair_id, branch, x.s state, x.m memory, x.r request from p""")
def branch_examples(spark, d):
    """A row for each branch of every pair, of repeated ones the last."""
    p = pairs.pivot_pairs(table(spark, d, "requests"), "pair_id", "branch", "loaded_utc", ["state", "memory", "request"])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("branch"), F.col(x).alias("x")) for x in "ab"]))
    return p.select("pair_id", each.alias("e")).where("e.x is not null").select("pair_id", "e.branch", "e.x.*")


@query(r"""select id, loaded_utc, regexp_replace(coalesce(list_filter(turns, lambda t: t.role = 'user')[1].text, ''), '^\s+|\s+$', '', 'g') || ' || ' || array_to_string(flatten(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: coalesce(list_transform(json_extract(t.calls, '$[*].name'), lambda n: n ->> '$'), []))), ' ') signature from examples""")
def turn_signatures(spark, d):
    """What is asked and what is called, as one text."""
    return table(spark, d, "examples").select("id", "loaded_utc", render.turn_signature(F.col("turns")).alias("signature"))


@query("select id, loaded_utc, list_filter(turns, lambda t: t.role = 'assistant')[1].calls expected from examples")
def reference_calls(spark, d):
    """The calls that are expected first."""
    return table(spark, d, "examples").select("id", "loaded_utc", render.first_calls_of(F.col("turns")).alias("expected"))


@query("""with p as (select pair_id, branch, arg_max(coalesce(memory, '') || chr(10) || coalesce(state, '') || chr(10) || coalesce(request, ''), loaded_utc) x from requests where pair_id is not null group by all),
l as (select a.pair_id, string_split(a.x, chr(10)) a, string_split(b.x, chr(10)) b from p a join p b on a.pair_id = b.pair_id and a.branch = 'a' and b.branch = 'b')
select pair_id, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]) lines from l""")
def prompt_differences(spark, d):
    """Lines in which the prompts of a pair's branches differ."""
    r = table(spark, d, "requests").withColumn("prompt", F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("memory", "state", "request")]))
    p = pairs.pivot_pairs(r, "pair_id", "branch", "loaded_utc", ["prompt"]).where("a is not null and b is not null")
    return p.select("pair_id", render.changed_lines(F.col("a.prompt"), F.col("b.prompt")).cast("array<bigint>").alias("lines"))


@query("""with s as (select id, loaded_utc, list_sum(list_transform(turns, lambda t: case when t.role = 'assistant' then strlen('<|assistant|>' || chr(10) || '<think>' || coalesce(t.think, '') || '</think><response>' || coalesce(t.calls, '') || '</response>' || chr(10)) else 0 end)) scored,
strlen('<|system|>' || chr(10) || coalesce(system_prompt, '') || coalesce(chr(10) || '<state>' || state || '</state>', '') || chr(10)) + list_sum(list_transform(turns, lambda t: strlen('<|' || t.role || '|>' || chr(10) || case when t.role = 'assistant' then '<think>' || coalesce(t.think, '') || '</think><response>' || coalesce(t.calls, '') || '</response>' else coalesce(t.text, t.result, '') end || chr(10)))) n from examples)
select id, loaded_utc, scored::double / n share from s""")
def scored_shares(spark, d):
    """The part of every document that a model is scored on."""
    parts = render.segments(F.col("turns"), F.col("system_prompt"), F.col("state"))
    return table(spark, d, "examples").select("id", "loaded_utc", render.scored_share(parts).alias("share"))


@query(f"""select category, id, left(list_filter(turns, lambda t: t.role = 'user')[1].text, 1800) opening from (select *, {_key('category')} category, row_number() over (partition by {_key('category')} order by id, loaded_utc) r from examples) e(id, raw, subtype, system_prompt, tools, state, memory, turns, spec_id, family, branch, group_key, session_key, loaded_utc, category, r) where r = 1""")
def first_per_category(spark, d):
    """One example of every category to be read."""
    e = table(spark, d, "examples").select(key(F.col("category")).alias("category"), "id", "loaded_utc", F.left(F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(0))["text"], F.lit(1800)).alias("opening"))
    return order.first_n(e, ["category"], ["id", "loaded_utc"], 1).drop("loaded_utc")


@query("select id, json_extract(state, '$.machines[0].id')::varchar \"first\", json_extract(state, '$.stock') is not null has_stock, json_extract(state, '$.machines[999]') is not null beyond from requests where state is not null")
def pointer_values(spark, d):
    """Values at pointers into states, and whether they resolve."""
    r = table(spark, d, "requests").where("state is not null")
    at = lambda f, p: f(F.col("state"), F.lit(p))
    return r.select("id", at(jsonx.pointer_get, "/machines/0/id").alias("first"), at(jsonx.pointer_exists, "/stock").alias("has_stock"), at(jsonx.pointer_exists, "/machines/999").alias("beyond"))


@query(rf"""with {_PAIRS_SQL}, n as (select pair_id, len(pointers) n from ({_DIFFS})), f as (select p.pair_id, case when ma is distinct from mb then 'swap_memory_diverged' when n.n <> 1 then 'swap_state_diverged' when ra is distinct from rb then 'swap_request_diverged' end f, a, b
  from p join n using (pair_id))
select pair_id, 'a' branch, coalesce(f, case when not json_valid(a) then 'not_json' end, case when not json_valid(b) then 'partner_failed' end) fault from f union all select pair_id, 'b', coalesce(f, case when not json_valid(b) then 'not_json' end, case when not json_valid(a) then 'partner_failed' end) from f""")
def pair_verdicts(spark, d):
    """Every branch's fault, in the fixed order of faults of pairs; a branch whose partner fails is refused too."""
    p = pairs.pivot_pairs(table(spark, d, "requests"), "pair_id", "branch", "loaded_utc", ["state", "memory", "request"]).where("a is not null and b is not null")
    own = {x: F.when(F.try_parse_json(F.col(f"{x}.state")).isNull() & F.col(f"{x}.state").isNotNull(), "not_json") for x in "ab"}
    f = pairs.pair_faults(p, pairs.swap_checks(), own)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("branch"), F.col(f"fault_{x}").alias("fault")) for x in "ab"]))
    return f.select("pair_id", each.alias("e")).select("pair_id", "e.*")


@query(rf"""select {_key('subtype')} subtype, count(*) trials, count(distinct regexp_replace(seed_topic, '\bb_\d+\b', '<id>', 'g')) "distinct", count(distinct regexp_replace(seed_topic, '\bb_\d+\b', '<id>', 'g')) < count(*) * 0.5 saturated from requests group by 1""")
def distinct_capacity(spark, d):
    """Different seeds, ids aside, among the requests of every subtype."""
    r = table(spark, d, "requests").select(key(F.col("subtype")).alias("subtype"), text.without_ids(F.col("seed_topic")).alias("seed"))
    return plan.capacity(r, "subtype", F.col("seed"))


# Checks and whole graphs


@query(f"""with r as (select {_key('category')} category, count(distinct id) n from requests where id in (select id from examples) group by 1), e as (select {_key('category')} category, count(distinct id) n from examples group by 1)
select coalesce(r.category, e.category) category, r.n recorded, e.n rebuilt, case when r.n is null then 'not_recorded' when e.n is null then 'not_rebuilt' when r.n = e.n then 'equal' else 'differs' end status from r full join e on r.category = e.category where coalesce(r.category, e.category) is not null""")
def rebuilt_counts(spark, d):
    """Examples of every category against the requests that they were made for."""
    e = table(spark, d, "examples").select("id", key(F.col("category")).alias("category"))
    r = table(spark, d, "requests").select("id", key(F.col("category")).alias("category")).join(e.select("id").distinct(), "id", "left_semi")
    count = lambda t: t.where("category is not null").groupBy("category").agg(F.countDistinct("id").alias("n"))
    return checks.compared(count(r), count(e), "category", "n")


@query(f"select subtype from (select {_key('subtype')} subtype from requests intersect select {_key('subtype')} from outputs) where subtype is not null")
def shared_subtypes(spark, d):
    """Subtypes that are both planned and scored."""
    named = [table(spark, d, t).select(key(F.col("subtype")).alias("subtype")) for t in ("requests", "outputs")]
    return checks.shared(*named, "subtype")


@query("""with m as (select avg(epoch_us(loaded_utc)) mean from requests), b as (select pair_id, list_sort(list_distinct(list(branch))) branches from requests, m where pair_id is not null and epoch_us(loaded_utc) <= mean group by 1) select * from b where branches <> ['a', 'b']""")
def early_pair_integrity(spark, d):
    """Pairs of which one branch is loaded later than the mean of all requests."""
    r = table(spark, d, "requests").withColumn("at", F.unix_micros(F.to_timestamp("loaded_utc")))
    r = r.crossJoin(F.broadcast(r.agg(F.avg("at").alias("mean")))).where("at <= mean")  # one row
    return pairs.integrity(r, "pair_id", "branch")


@query("with k as (select distinct o_custkey k from orders), e as (select 'c' || o_custkey node, 'c' || o_custkey root from orders union select 'o' || o_orderkey, 'c' || o_custkey from orders) select root, count(*) nodes from e group by root")
def order_components(spark, d):
    """Customers with all their orders, found as components of the whole graph; a component is named by its least node."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b"))
    return connected_components(o).groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes")).select(F.col("least").alias("root"), "nodes")


@query("""with c as (select distinct date_diff('day', (select min(o_orderdate) from orders), o_orderdate)::bigint step from orders), m as (select max(step) most from c), r as (select *, row_number() over (order by step desc) r from c)
select step, r <= 4 or exists (select 1 from range(1, 11) t(k), m where abs(step - round_even(most * k / 10.0, 0)) < 25) kept from r""")
def retention_by_day(spark, d):
    """Days with orders as checkpoints: the last four, and those near each tenth of the whole time."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    first = o.agg(F.min("day").alias("first"))
    c = o.distinct().crossJoin(F.broadcast(first)).select(F.datediff("day", "first").cast("bigint").alias("step"))  # one row
    return diagnose.retained(c, "step", 4, 25, c.agg(F.max("step")).first()[0] or 0)


@query("select user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) over w) step_us, case when epoch_us(ts) > epoch_us(lag(ts) over w) then value * 1e6 / (epoch_us(ts) - epoch_us(lag(ts) over w)) end per_second, (count(*) over (partition by user_id) - row_number() over w)::bigint steps_left from events window w as (partition by user_id order by ts, event_id)")
def step_rates(spark, d):
    """Time since a user's last event, value per second, and events that are still to come."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.to_timestamp("ts"))
    e = table(spark, d, "events").select("user_id", "event_id", "value", (us - F.lag(us).over(w)).alias("step_us"), (F.count(F.lit(1)).over(Window.partitionBy("user_id")) - F.row_number().over(w)).alias("steps_left"))
    return e.select("user_id", "event_id", "step_us", F.when(F.col("step_us") > 0, F.col("value") * 1e6 / F.col("step_us")).alias("per_second"), "steps_left")
