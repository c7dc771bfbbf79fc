"""Queries of the operators for training data, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import MISSING_WORDS, key, lang
from millrace.llm import leakage, mixing, neardup, packing, pieces, sampling, splits, tokens
from millrace.sources.tables import table


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "data_config"), key(F.col("source")), F.col("n_chars"), F.col("doc_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of recipes that cannot be filled."""
    return _mix(spark, d).asked.where("not reachable").select("config_id", "source_key")


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of every recipe and how often each is used."""
    return _mix(spark, d).records.withColumnRenamed("record_key", "doc_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached."""
    return _mix(spark, d).plan


def _split(spark: SparkSession, d: str) -> splits.Split:
    ties = [key(F.col("group_key")), key(F.col("spec_id"))]
    return splits.split_records(table(spark, d, "outputs"), table(spark, d, "split_targets"), F.col("output_id"), ties, key(F.col("category")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that are tied to others, with the least id of all that are."""
    return _split(spark, d).entities.where("entity_size > 1").select(F.col("record_id").alias("output_id"), "entity_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every output."""
    return _split(spark, d).records.select(F.col("record_id").alias("output_id"), "entity_id", "entity_size", F.col("label").alias("category"), "split_name")


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of every category in the splits."""
    return _split(spark, d).report


def _similar(spark: SparkSession, d: str) -> neardup.SimilarSets:
    return neardup.similar_sets(neardup.example_texts(table(spark, d, "examples"), table(spark, d, "requests")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of examples that say nearly the same."""
    return _similar(spark, d).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each example's class and number of links."""
    return _similar(spark, d).groups()


def _totals(spark: SparkSession, d: str) -> DataFrame:
    slices = {"source": key(F.col("source")), "lang": lang(F.col("lang")), "domain": key(F.col("domain"))}
    return tokens.token_totals(table(spark, d, "documents"), slices)


def p3_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document, with its source, language and domain."""
    docs = table(spark, d, "documents")
    n = tokens.document_tokens(docs, F.col("doc_id")).withColumnRenamed("record_key", "doc_id")
    return docs.select("doc_id", key(F.col("source")).alias("source"), lang(F.col("lang")).alias("lang"), key(F.col("domain")).alias("domain")).join(n, "doc_id")


def p3_token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by source, language and domain."""
    return _totals(spark, d)


def p3_budget_cover(spark: SparkSession, d: str) -> DataFrame:
    """Tokens at hand against the budgets of the recipes."""
    return tokens.budget_cover(_totals(spark, d), table(spark, d, "data_config"))


def _sample(spark: SparkSession, d: str) -> sampling.Sample:
    cell = {n: key(F.col(n)) for n in ("category", "domain", "subtype")}
    return sampling.sample_cells(table(spark, d, "requests"), table(spark, d, "sample_targets"), F.col("id"), cell, F.col("loaded_utc"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of plans that cannot be filled."""
    return _sample(spark, d).report.where("short").select("plan_id", "category", "domain", "subtype")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The requests that each plan draws."""
    return _sample(spark, d).records.withColumnRenamed("record_id", "id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """What each cell was asked for and has."""
    return _sample(spark, d).report.withColumn("expected", F.round(F.col("available") * F.col("probability"), 8)).drop("probability")


def _margins(spark: SparkSession, d: str) -> sampling.Sample:
    """The shares of every category, domain and subtype that the cells of a plan add up to, each a target of its own."""
    cell = {n: key(F.col(n)) for n in ("category", "domain", "subtype")}
    t = table(spark, d, "sample_targets").where("category is not null and domain is not null and subtype is not null")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in cell]))
    t = t.select("plan_id", "sample_fraction", each.alias("m"), "target_share").groupBy("plan_id", "m.dimension", "m.value").agg(F.max("sample_fraction").alias("sample_fraction"), F.sum("target_share").alias("target_share"))
    return sampling.sample_margins(table(spark, d, "requests"), t.withColumn("min_rows", F.lit(1)), F.col("id"), cell, F.col("loaded_utc"))


def p5_margins(spark: SparkSession, d: str) -> DataFrame:
    """What single categories, domains and subtypes, which overlap, were asked for and can have at once."""
    return _margins(spark, d).report


def p5_margin_sample(spark: SparkSession, d: str) -> DataFrame:
    """The requests drawn for shares of single columns."""
    return _margins(spark, d).records.withColumnRenamed("record_id", "id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container for every capacity."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "size_limits")).items


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and the room that is used, against a lower bound."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "size_limits")).report


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), item_answer="expected")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items and the number of documents with passages of them, and with their answers too."""
    return leakage.leaked_items(_leaks(spark, d), table(spark, d, "eval_items"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How much of an item's question a document holds, and whether it holds the answer."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are larger than a capacity, and those with too large a stretch."""
    return pieces.oversized_cases(pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits"), with_text=False))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return pieces.split_oversized(table(spark, d, "documents"), table(spark, d, "size_limits"))


# What must hold of results that depend on hashes, beside numbers that SQL has too


def p1_holds(spark: SparkSession, d: str) -> DataFrame:
    """No record of a mix is used too often, its size is the share's or, if that can't be had, all there is, and it is the size reported."""
    m = _mix(spark, d)
    r = m.records.groupBy("config_id", "source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.max("copies").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("record_key").alias("keys"), F.max("size").alias("drawn"))
    largest = table(spark, d, "documents").groupBy(key(F.col("source")).alias("source_key")).agg(F.max("n_chars").alias("largest"))
    p = m.plan.join(r, ["config_id", "source_key"], "left").join(largest, "source_key", "left").fillna(0, ["used", "most", "n", "keys", "largest"])
    near = F.when(F.col("reachable"), F.abs(F.col("used") - F.col("target_size")) <= F.col("largest") / 2 + 1e-6).otherwise(F.col("used") == F.col("xlam_epochs") * F.col("available"))
    holds = near & (F.col("most") <= F.col("xlam_epochs")) & (F.col("n") == F.col("keys")) & (F.col("used") == F.col("actual_size"))
    return p.select("config_id", "source_key", "available", F.round("target_size", 3).alias("target"), "reachable", holds.alias("holds"))


def p2_holds(spark: SparkSession, d: str) -> DataFrame:
    """No entity is in two splits, and every category is in each within 2 % of its records, or two records, of what is wanted."""
    s = _split(spark, d)
    apart = s.records.groupBy("entity_id").agg(F.countDistinct("split_name").alias("s")).agg(F.count_if(F.col("s") > 1).alias("separated"))
    n = F.sum("records").over(Window.partitionBy("label"))
    ok = s.report.select("label", "records", (F.abs(F.col("records") - F.col("wanted") * n) <= F.greatest(F.lit(2.0), n * 0.02)).alias("ok"))
    return ok.groupBy(F.col("label").alias("category")).agg(F.sum("records").alias("records"), F.bool_and("ok").alias("balanced")).crossJoin(apart)  # one row


def p3_holds(spark: SparkSession, d: str) -> DataFrame:
    """The totals of slices are the sums of their documents' tokens, and no text has more tokens than bytes."""
    docs = p3_document_tokens(spark, d).join(table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "doc_id")
    by = ["source", "lang", "domain"]
    each = docs.groupBy(*by).agg(F.sum("tokens").alias("t"), F.sum("bytes").alias("bytes"), F.bool_and((F.col("tokens") <= F.col("bytes")) & ((F.col("tokens") > 0) == (F.col("bytes") > 0))).alias("ok"))
    same = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit(""))
    k = F.concat_ws("|", *[same(F.col(x)) for x in by])
    t = _totals(spark, d).select(k.alias("k"), *by, "documents", "tokens").join(each.select(k.alias("k"), "t", "bytes", "ok"), "k")
    return t.select(*by, "documents", F.col("bytes").cast("bigint").alias("bytes"), (F.col("ok") & (F.col("t") == F.col("tokens"))).alias("holds"))


def p5_holds(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of a plan has the floor or ceiling of what is wanted, or all it has, and no request is drawn twice for a plan."""
    s = _sample(spark, d)
    cell = ["plan_id", "category", "domain", "subtype"]
    drawn = s.records.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"))
    goal = F.least("wanted", "available")
    ok = (F.col("n") >= F.floor(goal - 1e-6)) & (F.col("n") <= F.ceil(goal + 1e-6)) & (F.col("n") == F.col("ids"))
    return s.report.join(drawn, cell, "left").fillna(0, ["n", "ids"]).select(*cell, "available", F.round("wanted", 8).alias("wanted"), ok.alias("holds"))


def p6_holds(spark: SparkSession, d: str) -> DataFrame:
    """Every token is in one container, none is over its capacity, only larger documents are cut, and containers are within 2 % of the bound."""
    p, size = packing.pack(table(spark, d, "documents"), table(spark, d, "size_limits")), F.col("end_token") - F.col("start_token")
    limits = F.broadcast(table(spark, d, "size_limits").select("limit_id", "capacity_tokens"))
    load = p.items.where("container_id <> 'empty'").groupBy("limit_id", "container_id").agg(F.sum(size).alias("load")).join(limits, "limit_id")
    load = load.groupBy("limit_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("over_capacity"), F.count(F.lit(1)).alias("containers"))
    docs = p.items.groupBy("limit_id", "doc_id").agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("pieces")).join(limits, "limit_id")
    docs = docs.groupBy("limit_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("cut"))
    r = p.report.select("limit_id", F.col("containers").alias("said"), "lower_bound")
    near = (F.col("containers") == F.col("said")) & (F.col("containers") <= 1.02 * F.col("lower_bound") + 1) & (F.col("containers") >= F.col("lower_bound") - 1e-6)
    return docs.join(load, "limit_id").join(r, "limit_id").select("limit_id", "documents", "tokens", "over_capacity", "cut", near.alias("near"))


def p8_holds(spark: SparkSession, d: str) -> DataFrame:
    """Pieces fit, cover their document and overlap by what is asked for, or up to three bytes more."""
    p = p8_pieces(spark, d).join(F.broadcast(table(spark, d, "size_limits").select("limit_id", "capacity_tokens", "overlap_tokens")), "limit_id")
    size, before = F.col("end_token") - F.col("start_token"), F.lag("end_token").over(Window.partitionBy("limit_id", "doc_id").orderBy("piece_no"))
    p = p.withColumn("shared", before - F.col("start_token"))
    fits = (size <= F.col("capacity_tokens")) & (F.octet_length("piece") == size) & F.coalesce(F.col("shared").between(F.col("overlap_tokens"), F.col("overlap_tokens") + 3), F.col("start_token") == 0)
    docs = p.groupBy("limit_id", "doc_id").agg(F.bool_and(fits).alias("ok"), F.max("end_token").alias("n"), (F.max("piece_no") + 1 == F.max("n_pieces")).alias("all"))
    return docs.groupBy("limit_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.bool_and(F.col("ok") & F.col("all")).alias("holds"))


QUERIES = (
    p1_found, p1_mix, p1_shares, p1_holds, p2_found, p2_splits, p2_balance, p2_holds, p3_token_totals, p3_document_tokens, p3_budget_cover, p3_holds, p4_found, p4_groups,
    p5_found, p5_sample, p5_report, p5_margins, p5_margin_sample, p5_holds, p6_containers, p6_report, p6_holds, p7_found, p7_items, p7_leaks, p8_found, p8_pieces, p8_holds,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


MISSING = ", ".join(f"'{w}'" for w in MISSING_WORDS)
PLAIN = "regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g')"
KEY = f"(case when {PLAIN} not in ({MISSING}) then {PLAIN} end)"


#: Letters and digits of full width, the only characters besides composition that NFKC changes in these tables.
WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
WORDS = "regexp_extract_all(lower(nfc_normalize(translate(regexp_replace({0}, '[\u00ad\u200b\u200c\u2060]', '', 'g'), '" + WIDE + "', '" + "".join(chr(ord(c) - 0xFEE0) for c in WIDE) + "'))), '[\\p{{L}}\\p{{N}}]+')"
RUNS = "unnest(list_transform(range(1, greatest(1, len(w) - 10)), lambda i: array_to_string(w[i:i + 11], ' ')))"
LEAKS = f"""
i as (select item_id, suite, {WORDS.format('text')} w, {WORDS.format('expected')} a from eval_items), d as (select doc_id, {WORDS.format('text')} w from documents),
ig as (select distinct item_id, {RUNS} g from i), dg as (select distinct doc_id, {RUNS} g from d),
n as (select item_id, count(*) n from ig group by 1), m as (select doc_id, item_id, count(*) c from ig join dg using (g) group by all),
leaks as (select doc_id, item_id, c::double / n question_share, contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.a, ' ') || ' ') answer from m join n using (item_id) join i using (item_id) join d using (doc_id))"""
SETS = """
r as (select id, arg_max(seed_topic, loaded_utc) topic from requests where seed_topic is not null group by id),
e as (select id, any_value(turns) turns from examples group by id),
t as (select e.id, lower(concat_ws(' ', coalesce(topic, ''), array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'user'), lambda t: coalesce(t.text, '')), ' '),
    array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: coalesce(t.think, '')), ' '))) x from e left join r using (id)),
w as (select id, regexp_extract_all(x, '[\\p{L}\\p{N}]+') w from t),
g as (select distinct id, unnest(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from w)"""
MIX = f"""
s as (select {PLAIN.format('source')} source_key, sum(n_chars) available from documents group by 1), c as (select *, sum(budget_tokens) over (partition by config_id) b from data_config),
p as (select config_id, source_key, coalesce(available, 0)::bigint available, xlam_epochs, budget_tokens::double / b * mix_ratio * (select sum(n_chars) from documents) target from c left join s using (source_key))"""
CELLS = f"""
r as (select id, max({KEY.format('category')}) c, max({KEY.format('domain')}) d, max({KEY.format('subtype')}) s from requests where id is not null group by id),
n as (select c, d, s, count(*) n from r where c is not null and d is not null and s is not null group by all),
t as (select plan_id, category, domain, subtype, target_share, min_rows, coalesce(n, 0) available, greatest(min_rows, target_share * sample_fraction * (select count(*) from r)) wanted from sample_targets left join n on c = category and d = domain and s = subtype)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_holds": f"with {MIX} select config_id, source_key, available, round(target, 3) target, target <= xlam_epochs * available reachable, true holds from p",
        "p2_holds": f"with o as (select output_id, min({KEY.format('category')}) category from outputs group by 1) select category, count(*)::bigint records, true balanced, 0::bigint separated from o group by 1",
        "p3_holds": f"""with o as (select {KEY.format('source')} source, {KEY.format('lang')} l, {KEY.format('domain')} domain, coalesce(strlen(text), 0) n from documents)
select source, case split_part(l, '_', 1) when 'py' then 'python' when 'python3' then 'python' else split_part(l, '_', 1) end lang, domain, count(*) documents, sum(n)::bigint bytes, true holds from o group by all""",
        "p4_groups": f"""with recursive {SETS},
s as (select id, string_agg(g, '|' order by g) k, count(*) n from g group by id), h as (select k, min(id) head, count(*) copies, any_value(n) n from s group by k),
hg as (select id, g from g join h on head = id),
p as (select x.id a, y.id b, count(*) c from hg x join hg y on x.g = y.g and x.id < y.id group by all),
l as (select a, b from p join h x on x.head = a join h y on y.head = b where c / (x.n + y.n - c) >= 0.6), b as (select a, b from l union all select b, a from l),
reach as (select a, b from b union select reach.a, b.b from reach join b on reach.b = b.a), least_of as (select a, least(a, min(b)) class_id from reach group by a), degree as (select a, count(*) links from b group by a)
select e.id, coalesce(class_id, head, e.id) class_id, coalesce(copies, 1) copies, coalesce(links, 0) links from e left join s using (id) left join h using (k) left join least_of on least_of.a = head left join degree on degree.a = head""",
        "p5_report": f"with {CELLS} select plan_id, category, domain, subtype, target_share, min_rows, wanted, available, round(least(wanted, available), 8) expected, available < wanted short from t",
        "p5_holds": f"with {CELLS} select plan_id, category, domain, subtype, available, round(wanted, 8) wanted, true holds from t",
        "p6_holds": "select limit_id, count(*) documents, sum(coalesce(strlen(text), 0))::bigint tokens, 0::bigint over_capacity, 0::bigint cut, true near from documents, size_limits where doc_id is not null group by 1",
        "p7_found": f"with {LEAKS} select doc_id, item_id from leaks",
        "p7_leaks": f"with {LEAKS} select * from leaks",
        "p7_items": f"with {LEAKS} select item_id, suite, count(doc_id) documents, coalesce(count(*) filter (answer), 0) with_answer, count(doc_id) > 0 leaked from eval_items left join leaks using (item_id) group by all",
        "p8_holds": "select limit_id, count(*) documents, sum(strlen(text))::bigint tokens, true holds from documents, size_limits where strlen(text) > capacity_tokens group by 1",
        "p1_found": f"""
with s as (select {PLAIN.format('source')} k, sum(n_chars) n from documents group by 1),
c as (select *, sum(budget_tokens) over (partition by config_id) b from data_config)
select config_id, source_key from c left join s on s.k = c.source_key
where budget_tokens::double / b * mix_ratio * (select sum(n_chars) from documents) > xlam_epochs * coalesce(s.n, 0)""",
        "p2_found": f"""
with recursive o as (select output_id, {KEY.format('group_key')} g, {KEY.format('spec_id')} s from outputs),
k as (select distinct output_id, 'g' || g k from o where g is not null union select distinct output_id, 's' || s from o where s is not null),
e as (select distinct x.output_id a, y.output_id b from k x join k y using (k)),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select a output_id, min(b) entity_id from r group by a having count(*) > 1""",
        "p4_found": """
with r as (select id, arg_max(seed_topic, loaded_utc) topic from requests where seed_topic is not null group by id),
e as (select id, any_value(turns) turns from examples group by id),
t as (select e.id, lower(concat_ws(' ', coalesce(topic, ''), array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'user'), lambda t: coalesce(t.text, '')), ' '),
    array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: coalesce(t.think, '')), ' '))) x from e left join r using (id)),
w as (select id, regexp_extract_all(x, '[\\p{L}\\p{N}]+') w from t),
g as (select distinct id, unnest(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from w),
n as (select id, count(*) n from g group by id),
p as (select x.id a, y.id b, count(*) c from g x join g y on x.g = y.g and x.id < y.id group by all)
select a id_a, b id_b from p join n x on x.id = a join n y on y.id = b where c / (x.n + y.n - c) >= 0.6""",
        "p5_found": f"""
with r as (select id, max({KEY.format('category')}) c, max({KEY.format('domain')}) d, max({KEY.format('subtype')}) s from requests where id is not null group by id),
n as (select c, d, s, count(*) n from r where c is not null and d is not null and s is not null group by all)
select plan_id, category, domain, subtype from sample_targets left join n on c = category and d = domain and s = subtype
where coalesce(n, 0) < greatest(min_rows, target_share * sample_fraction * (select count(*) from r))""",
        "p8_found": """
with x as (select limit_id, doc_id, capacity_tokens c, text from documents, size_limits where strlen(text) > capacity_tokens)
select limit_id, doc_id, 'over' case_kind from x
union all select limit_id, doc_id, 'run' from x where list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r。]'), lambda y: strlen(y))) > c""",
    }
