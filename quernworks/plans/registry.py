"""The registered queries of the engine's own operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import category, chain, complexity, exact, extract, labels
from ..operators import bootstrap, calibrate, dedup, grids, joins, sampling, scores, stats
from ..schemas import CATEGORIES, json_field
from ..session import table
from . import stages, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- text: complexity ----
_WORD_LISTS = {"spatial": complexity.SPATIAL_WORDS, "conjunctions": complexity.CONJUNCTIONS, "verbs": complexity.EDIT_VERBS}


def _complexity_sql(text: str) -> str:
    """DuckDB expression over a list column t of lower-cased tokens of ``text``."""
    t = f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z'']+'), lambda x: lower(x))"
    count = lambda k: f"len(list_filter({t}, lambda x: list_contains([{', '.join(repr(w) for w in _WORD_LISTS[k])}], x)))"
    parts = [f"least(1, len({t}) / 25.0::double)", f"least(1, {count('verbs')} / 3.0::double)", f"least(1, {count('conjunctions')} / 2.0::double)", f"least(1, {count('spatial')} / 2.0::double)"]
    return f"case when len({t}) = 0 then 0 else {' + '.join(f'0.25::double * {p}' for p in parts)} end"


@query(f"select doc_id, round({_complexity_sql('text')}, 6) as complexity from documents")
def complexity_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(complexity.complexity(F.col("text")), 6).alias("complexity"))


@query(f"select triplet_id, round({_complexity_sql('instruction')}, 6) as complexity from ({synthetic.TRIPLETS_SQL})")
def complexity_instructions(spark, sf):
    return synthetic.triplets(spark, sf).select("triplet_id", F.round(complexity.complexity(F.col("instruction")), 6).alias("complexity"))


# ---- exact tertiles ----
_BINS_SQL = "case when s <= q33 then 'easy' when s > q66 then 'hard' else 'medium' end"


@query(f"""with b as (select quantile_cont(o_totalprice, 1/3.0::double) as q33, quantile_cont(o_totalprice, 2/3.0::double) as q66 from orders)
select o_orderkey, {_BINS_SQL.replace('s ', 'o_totalprice ')} as difficulty_bin from orders, b""")
def tertile_bins_orders(spark, sf):
    return stats.with_tertile_bins(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "difficulty_bin")


@query(f"""with b as (select quantile_cont(o_totalprice, 1/3.0::double) as q33, quantile_cont(o_totalprice, 2/3.0::double) as q66 from orders),
c as (select o_totalprice as s, {_BINS_SQL.replace('s ', 'o_totalprice ')} as bin from orders, b)
select count(s) as n, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, round(any_value(q33), 6) as q33, round(any_value(q66), 6) as q66,
count(*) filter (where bin = 'easy') as n_easy, count(*) filter (where bin = 'medium') as n_medium, count(*) filter (where bin = 'hard') as n_hard from c, b""")
def tertile_summary(spark, sf):
    rows = stats.with_tertile_bins(table(spark, sf, "orders"), "o_totalprice")
    return rounded(stats.score_summary(rows, "o_totalprice"), "mean", "std", "q33", "q66")


# ---- weighted scores ----
_CLIP = "least(greatest({}, 0), 1)"


def _line_components(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("structural_change"), (F.col("l_tax") * 12).alias("combined_diff_mean"),
        (F.col("l_quantity") / 50).alias("mask_area_frac"), (F.col("l_quantity") / 50).alias("mask_compactness"), F.lit("remove the dog and the cat").alias("instruction"),
    )


_LINE_SQL = f"select l_orderkey, l_linenumber, l_discount * 10 as s, l_tax * 12 as p, l_quantity / 50 as a, {_complexity_sql(repr('remove the dog and the cat'))} as c from lineitem"


@query(f"select l_orderkey, l_linenumber, round({_CLIP.format('0.3::double * ' + _CLIP.format('s') + ' + 0.3::double * ' + _CLIP.format('p') + ' + 0.2::double * ' + _CLIP.format('1 - a') + ' + 0.2::double * c')}, 6) as difficulty_raw from ({_LINE_SQL})")
def weighted_score_v1(spark, sf):
    rows = scores.score(_line_components(spark, sf), scores.ScoreConfig(version=1))
    return rounded(rows.select("l_orderkey", "l_linenumber", "difficulty_raw"), "difficulty_raw")


@query(f"select l_orderkey, l_linenumber, round({_CLIP.format('0.55::double * ' + _CLIP.format('s') + ' + 0.25::double * ' + _CLIP.format('1 - ' + _CLIP.format('a')) + ' + 0.2::double * c')}, 6) as difficulty_raw from ({_LINE_SQL})")
def weighted_score_v2(spark, sf):
    rows = scores.score(_line_components(spark, sf))
    return rounded(rows.select("l_orderkey", "l_linenumber", "difficulty_raw"), "difficulty_raw")


# ---- deduplication ----
_EVENT = "user_id, event_id, event_type, value"


@query(f"select {_EVENT} from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def dedup_keep_last_events(spark, sf):
    return dedup.keep_last(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select(*_EVENT.split(", "))


@query(f"select {_EVENT} from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1")
def dedup_keep_first_events(spark, sf):
    return dedup.keep_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select(*_EVENT.split(", "))


@query("select doc_id, lang, source from (select *, count(*) over (partition by text) as n from documents) where n = 1 or text is null")
def collision_drop_all_docs(spark, sf):
    return dedup.resolve_collisions(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "lang", "source")


@query("select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as r from documents where text is not null) where r = 1")
def collision_keep_first_docs(spark, sf):
    return dedup.resolve_collisions(table(spark, sf, "documents"), "text", ["doc_id"], "keep_first").select("doc_id", "lang", "source")


@query("select count(*) as n_collisions, coalesce(sum(n), 0)::bigint as n_records from (select text, count(*) as n from documents where text is not null group by text having count(*) > 1)")
def collision_report_docs(spark, sf):
    return dedup.collision_report(table(spark, sf, "documents").select("text", "doc_id"), "text", "doc_id").select("n_collisions", "n_records")


# ---- ids and names ----
@query(r"""with u as (select page_id, regexp_extract(url, '([^/]+?)/*$', 1) as name from pages)
select page_id, regexp_replace(regexp_replace(name, '^(.+)\.[^.]+$', '\1'), '[^A-Za-z0-9_\-]+', '_', 'g') as stem from u""")
def derive_id_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", exact.id_stem(F.col("url")).alias("stem"))


@query("select conv_id, turn, printf('magicbrush_train_%d_t%02d', conv_id, turn) as triplet_id, turn = 1 as source_is_authentic from conversations")
def derive_turn_id(spark, sf):
    name = exact.turn_id(F.lit("train"), F.col("conv_id").cast("string"), F.col("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", name.alias("triplet_id"), (F.col("turn") == 1).alias("source_is_authentic"))


@query(r"""with u as (select page_id, url, lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '[^/](\.[^./]+)$', 1)) as suffix from pages)
select page_id, concat(substr(sha1(url), 1, 16), case when suffix in ('.jpg', '.jpeg', '.png', '.webp') then suffix else '.jpg' end) as file from u""")
def url_cache_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", exact.cache_name(F.col("url")).alias("file"))


# ---- joins ----
@query("select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def lookup_inner_join(spark, sf):
    return joins.lookup_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def semi_matched(spark, sf):
    return joins.matched(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_unmatched(spark, sf):
    return joins.unmatched(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey""")
def four_way_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = joins.lookup_join(rows, t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    rows = joins.lookup_join(rows, t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
    return joins.lookup_join(rows, t("region"), "r_regionkey").select("o_orderkey", "c_name", "n_name", "r_name")


@query("""select count(*) as n, count(*) filter (where l.doc_id is null) as n_without_labels, count(*) filter (where s.doc_id is null) as n_without_small,
count(*) filter (where l.doc_id is not null and s.doc_id is not null) as n_joined
from documents d left join (select distinct doc_id from labels) l using (doc_id) left join (select doc_id from documents where n_chars < 1000) s using (doc_id)""")
def join_counters(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return joins.join_counts(docs, {"labels": table(spark, sf, "labels"), "small": docs.filter("n_chars < 1000")}, "doc_id")


def _runs(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("triplet_id"), (F.col("o_custkey") % 50 / 49).alias("x"), (F.col("o_orderkey") % 30 / 29).alias("y"))
    scope = lambda c, cut: F.when(F.col(c) >= cut, "global").when(F.col(c) >= cut / 2, "local").otherwise("ambiguous")
    make = lambda c, cut: rows.select("triplet_id", scope(c, cut).alias("edit_scope"), ((F.col("x") + F.col("y")) / 2).alias("mask_area_frac"), F.col(c).alias("combined_diff_mean"))
    return make("x", 0.6), make("y", 0.5)


_SCOPE = "case when {0} >= {1} then 'global' when {0} >= {1} / 2 then 'local' else 'ambiguous' end"
_RUNS_SQL = f"""runs as (select triplet_id, {_SCOPE.format('ca', '0.6::double')} as sa, {_SCOPE.format('cb', '0.5::double')} as sb, (ca + cb) / 2 as area, ca, cb
from (select o_orderkey as triplet_id, o_custkey % 50 / 49 as ca, o_orderkey % 30 / 29 as cb from orders))"""


@query(f"with {_RUNS_SQL} select triplet_id, sa as edit_scope_a, ca as combined_diff_mean_a, sb as edit_scope_b, cb as combined_diff_mean_b from runs")
def pair_two_runs(spark, sf):
    a, b = _runs(spark, sf)
    return joins.pair_runs(a, b, "triplet_id", ["edit_scope", "combined_diff_mean"])


@query(f"""with {_RUNS_SQL}, l as (select distinct sa from runs), m as (select distinct sb from runs)
select concat(l.sa, '__', m.sb) as pair, (select count(*) from runs r where r.sa = l.sa and r.sb = m.sb) as n from l, m""")
def scope_crosstab_flat(spark, sf):
    a, b = _runs(spark, sf)
    return stats.flat_crosstab(joins.pair_runs(a, b, "triplet_id", ["edit_scope"]), "edit_scope_a", "edit_scope_b")


@query(f"""with {_RUNS_SQL} select count(*) as n, count(*) filter (where sa = 'global' and sb = 'global') as confirmed_global,
count(*) filter (where sa = 'global' and sb <> 'global') as a_only, count(*) filter (where sa <> 'global' and sb = 'global') as b_only,
count(*) filter (where sa = 'local' and sb = 'local') as both_local,
round(avg(area) filter (where sa = 'global' and sb = 'global'), 6) as mean_area_a, round(avg(case when area >= 0.999 then 1.0 else 0.0 end) filter (where sa = 'global' and sb = 'global'), 6) as full_area_a,
round(avg(ca) filter (where sa = 'global' and sb = 'global'), 6) as mean_cdm_a,
round(avg(area) filter (where sa = 'global' and sb = 'global'), 6) as mean_area_b, round(avg(case when area >= 0.999 then 1.0 else 0.0 end) filter (where sa = 'global' and sb = 'global'), 6) as full_area_b,
round(avg(cb) filter (where sa = 'global' and sb = 'global'), 6) as mean_cdm_b from runs""")
def segment_summary(spark, sf):
    found = stages.compare_masks_summary(*_runs(spark, sf))
    return rounded(found, *[f"{c}_{r}" for c in ("mean_area", "full_area", "mean_cdm") for r in "ab"])


# ---- categories ----
def _sql_text(text: str) -> str:
    return "concat(" + ", chr(39), ".join(f"'{x}'" for x in text.split("'")) + ", '')"


_LABEL_CASE = " ".join(f"when {_sql_text(t)} then '{c}'" for c, ts in category.LABELS.items() for t in ts)
_RULE = lambda i, other: "case " + " ".join(f"when regexp_matches(text, '{r[3]}', 'i') then {repr(r[i]) if i != 0 else repr('rule:' + r[0])}" for r in category.RULES) + f" else {other} end"
CATEGORIES_SQL = f"""tri as ({synthetic.TRIPLETS_SQL}),
lab as (select *, case when source_dataset = 'Pico-Banana' and json_valid(metadata) and trim(json_extract_string(metadata, '$.source_edit_type')) <> ''
  then json_extract_string(metadata, '$.source_edit_type') end as raw, coalesce(instruction, '') as text from tri),
known as (select *, case lower(trim(raw)) {_LABEL_CASE} end as mapped from lab),
cat as (select triplet_id, case when raw is not null then coalesce(mapped, 'other') else {_RULE(1, "'other'")} end as category,
  (case when raw is not null then case when mapped is null then 0.5 else 1.0 end else {_RULE(2, "0.2")} end)::double as confidence,
  case when raw is not null then 'dataset_label' when {_RULE(0, "''")} <> '' then 'rule_based' else 'fallback' end as source,
  case when raw is not null then case when mapped is null then concat('unmapped:', substr(raw, 1, 80)) else concat('label:', raw) end
    else {_RULE(0, "concat('no-rule-matched:', substr(text, 1, 60))")} end as rationale from known)"""


def _categories(spark, sf):
    return stages.category_stage(synthetic.triplets(spark, sf))


@query(f"with {CATEGORIES_SQL} select * from cat")
def classify_triplets(spark, sf):
    return _categories(spark, sf)


@query(f"with {CATEGORIES_SQL} select triplet_id, category, rationale from cat where source = 'dataset_label'")
def label_map_lookup(spark, sf):
    return _categories(spark, sf).filter("source = 'dataset_label'").select("triplet_id", "category", "rationale")


@query(f"with {CATEGORIES_SQL} select triplet_id, category, confidence, rationale from cat where source <> 'dataset_label'")
def category_rules(spark, sf):
    return _categories(spark, sf).filter("source <> 'dataset_label'").select("triplet_id", "category", "confidence", "rationale")


@query(f"with {CATEGORIES_SQL}, names as (select unnest({list(CATEGORIES)}) as category) select names.category, count(cat.category) as n from names left join cat using (category) group by 1")
def category_counts_zero_filled(spark, sf):
    return category.category_counts(_categories(spark, sf))


@query(f"with {CATEGORIES_SQL} select source, count(*) as n, round((select avg(case when category = 'other' then 1.0 else 0.0 end) from cat), 6) as fraction_other from cat group by source")
def category_source_counts(spark, sf):
    return rounded(category.source_counts(_categories(spark, sf)), "fraction_other")


@query("""with l as (select nullif(trim(json_extract_string(props, '$.k')), '') as label from events)
select label, count(*) as n, round(100.0 * count(*) / (select count(*) from l), 6) as percent from l group by label""")
def json_key_histogram(spark, sf):
    return rounded(stats.key_histogram(table(spark, sf, "events"), json_field(F.col("props"), "k")), "percent")


@query(f"""with t as ({synthetic.TRIPLETS_SQL}), l as (select nullif(trim(case when json_valid(metadata) then json_extract_string(metadata, '$.source_edit_type') end), '') as label from t)
select count(*) as n_total, count(*) filter (where label is null) as n_missing, count(distinct label) as n_unique from l""")
def json_key_summary(spark, sf):
    return stats.key_summary(synthetic.triplets(spark, sf), json_field(F.col("metadata"), "source_edit_type"))


# ---- cross-tabs ----
_FLAGS = ("F", "O", "P")


@query("select o_orderpriority, " + ", ".join(f"count(*) filter (where o_orderstatus = '{s}') as \"{s}\"" for s in _FLAGS) + " from orders group by 1")
def crosstab_counts(spark, sf):
    return stats.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", _FLAGS)


@query("select o_orderpriority, " + ", ".join(f"round(100.0 * count(*) filter (where o_orderstatus = '{s}') / count(*) filter (where o_orderstatus in {_FLAGS}), 6) as \"{s}\"" for s in _FLAGS) + " from orders group by 1")
def crosstab_percent(spark, sf):
    counts = stats.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", _FLAGS)
    return rounded(stats.crosstab_percent(counts, "o_orderpriority", _FLAGS), *_FLAGS)


@query(r"""select concat('\texttt{', replace(p_type, '_', '\_'), '}', """ + ", ".join(f"' & ', count(*) filter (where p_size % 3 = {i})" for i in range(3)) + r", ' \\') as line from part group by p_type")
def crosstab_latex(spark, sf):
    rows = table(spark, sf, "part").withColumn("bin", F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("p_size") % 3 + 1)))
    return stats.crosstab_latex(stats.crosstab(rows, "p_type", "bin"), "p_type").select("line")


# ---- statistics ----
_PARTS = ["l_quantity", "l_discount", "l_tax"]


@query(" union all ".join(f"""select '{c}' as component, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q25,
round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, max({c}) as max, {f"round(avg(case when {c} = 0 then 1.0 else 0.0 end), 6)" if c == "l_tax" else "null::double"} as frac_eq_0 from lineitem""" for c in _PARTS))
def component_stats(spark, sf):
    found = stats.component_stats(table(spark, sf, "lineitem"), _PARTS, zero_share=("l_tax",))
    return rounded(found, "mean", "std", "q25", "q50", "q75", "frac_eq_0")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in _PARTS for b in _PARTS))
def pearson_matrix(spark, sf):
    return rounded(stats.pearson_matrix(table(spark, sf, "lineitem"), _PARTS), "r")


@query("select count(*) as n, round(avg(0.55::double * l_quantity + 0.25::double * l_discount + 0.2::double * l_tax), 6) as mean, round(stddev_pop(0.55::double * l_quantity + 0.25::double * l_discount + 0.2::double * l_tax), 6) as std from lineitem")
def weighted_std(spark, sf):
    found = stats.weighted_spread(table(spark, sf, "lineitem"), dict(zip(_PARTS, (0.55, 0.25, 0.2), strict=True)))
    return rounded(found, "mean", "std")


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as a,
rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0::double as b from lineitem)
select count(*) as n, round(corr(a, b), 6) as rho from r""")
def spearman(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query("""select s.scope, count(*) as n, round(avg(l_quantity), 6) as mean from (select 'all' as scope, l_quantity from lineitem union all
select case when l_returnflag = 'R' then 'global' else 'local' end, l_quantity from lineitem) s group by 1""")
def scope_subsets(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "global").otherwise("local").alias("s"), "l_quantity")
    named = stats.with_scopes(rows, "s")
    return named.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


# ---- sweeps ----
_STEPS = [20.0, 40.0, 60.0, 80.0, 100.0, 150.0]
_TARGETS = [0.5, 0.3, 0.1, 0.0]
_SWEEP_SQL = f"""sweep as (select event_type, t as threshold, count(value) as n, count(*) filter (where value >= t) as "count",
count(*) filter (where value >= t) / count(value)::double as rate from events, (select unnest({_STEPS}::double[]) as t) group by 1, 2)"""


def _sweep(spark, sf):
    return stats.threshold_sweep(table(spark, sf, "events"), "value", _STEPS, "event_type")


@query(f'with {_SWEEP_SQL} select event_type, threshold, n, "count", round(rate, 6) as rate from sweep')
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf), "rate")


@query(f"with {_SWEEP_SQL} select event_type, printf('%.2f', g) as target, min(threshold) filter (where rate <= g) as threshold from sweep, (select unnest({_TARGETS}::double[]) as g) group by 1, g")
def candidate_thresholds(spark, sf):
    return stats.candidate_thresholds(_sweep(spark, sf), _TARGETS, "event_type")


@query("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
round(quantile_cont(value, 0.75), 6) as p75, count(*) filter (where value >= 60) as n_global, round(count(*) filter (where value >= 60) / count(*)::double, 6) as global_rate from events group by 1""")
def sweep_stats(spark, sf):
    rows = table(spark, sf, "events").withColumn("scope", F.when(F.col("value") >= 60, "global").otherwise("local"))
    return rounded(stats.sweep_stats(rows, "value", "scope", "event_type"), "mean", "std", "p25", "p50", "p75", "global_rate")


# ---- samples and orders ----
_SHUFFLE = "md5(concat('{}:', {}))"


@query(f"select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by {_SHUFFLE.format(7, 'doc_id')}, doc_id) as r from documents where lang is not null and source is not null) where r <= 3")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, "doc_id", 7)


@query(f"select doc_id, row_number() over (order by {_SHUFFLE.format(3, 'doc_id')}, doc_id) as place from documents order by 2 limit 100")
def shuffled_sample(spark, sf):
    from pyspark.sql import Window

    rows = sampling.sample_rows(table(spark, sf, "documents").select("doc_id"), 100, "doc_id", 3)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(sampling.shuffle_key(3, "doc_id"), "doc_id")).cast("bigint"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def limit_ordered(spark, sf):
    return sampling.head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, [F.desc("o_totalprice"), "o_orderkey"])


@query("select p_type, count(*) as n from part group by 1 order by 2 desc, 1 limit 5")
def topk_labels(spark, sf):
    return sampling.most_common(table(spark, sf, "part"), "p_type", 5)


@query("select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier")
def union_all_shards(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


# ---- grids ----
def _cells(df: DataFrame, *grids_: str) -> DataFrame:
    return df.select("vec_id", F.explode(F.arrays_zip(*grids_)).alias("c")).select("vec_id", *[F.round(f"c.{g}", 6).alias(g) for g in grids_])


@query(f"with recursive {synthetic.GRIDS_SQL} select vec_id, round(unnest(nd), 6) as nd, round(unnest(ne), 6) as ne from norm")
def grid_percentile_norm(spark, sf):
    return _cells(synthetic.normalized_pairs(spark, sf), "nd", "ne")


@query(f"with recursive {synthetic.GRIDS_SQL} select vec_id, round(unnest(list_transform(range(1, 65), lambda i: greatest(nd[i], ne[i]))), 6) as g from norm")
def grid_max_combine(spark, sf):
    return _cells(synthetic.normalized_pairs(spark, sf).withColumn("g", grids.combine_max(F.col("nd"), F.col("ne"))), "g")


@query(f"with recursive {synthetic.GRIDS_SQL} select vec_id, round(unnest(list_transform(range(1, 65), lambda i: (nd[i] + ne[i]) / 2)), 6) as g from norm")
def grid_mean_combine(spark, sf):
    return _cells(synthetic.normalized_pairs(spark, sf).withColumn("g", grids.combine_mean(F.col("nd"), F.col("ne"))), "g")


@query(f"with recursive {synthetic.MASKS_SQL} select vec_id, diff_strongest_signal, mask_area_frac, edit_scope, confidence, combined_diff_mean from masks")
def grid_scope_routing(spark, sf):
    return synthetic.mask_artifacts(spark, sf).select("vec_id", "diff_strongest_signal", "mask_area_frac", "edit_scope", "confidence", "combined_diff_mean")


@query(f"with recursive {synthetic.MASKS_SQL} select vec_id, mask_compactness, spatial_descriptor from masks")
def grid_compactness_spatial(spark, sf):
    return synthetic.mask_artifacts(spark, sf).select("vec_id", "mask_compactness", "spatial_descriptor")


@query("""with p as (select a.vec_id, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
q as (select vec_id, i, x[8 * i + 1:8 * i + 8]::double[] as u, y[8 * i + 1:8 * i + 8]::double[] as v from (select *, unnest(range(8)) as i from p))
select vec_id, i as patch, round(1 - list_dot_product(u, v) / greatest(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)), 1e-12), 6) as distance from q""")
def patch_cosine_distance(spark, sf):
    rows = table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), grids.doubles(F.col("embedding")).alias("y"))
    pairs = rows.filter("vec_id % 2 = 0").select("vec_id", grids.doubles(F.col("embedding")).alias("x")).join(other, "vec_id")
    return pairs.select("vec_id", F.posexplode(grids.patch_distance(F.col("x"), F.col("y"), 8)).alias("patch", "d")).select("vec_id", F.col("patch").cast("bigint").alias("patch"), F.round("d", 6).alias("distance"))


def _overlaps(spark, sf):
    rows = table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), grids.above(F.col("embedding"), 0).alias("y"))
    pairs = rows.filter("vec_id % 2 = 0").select("vec_id", "label", grids.above(F.col("embedding"), 0).alias("x")).join(other, "vec_id")
    iou, dice = grids.overlap(F.col("x"), F.col("y"))
    scope = F.when(F.col("label") % 2 == 0, "local").otherwise("global")
    return pairs.select("vec_id", "label", scope.alias("edit_scope"), iou.alias("iou"), dice.alias("dice"))


_OVERLAP_SQL = """raw as (select a.vec_id, a.label, list_transform(range(1, 65), lambda i: a.embedding[i] > 0) as x, list_transform(range(1, 65), lambda i: b.embedding[i] > 0) as y
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0),
cnt as (select vec_id, label, len(list_filter(range(1, 65), lambda i: x[i] and y[i])) as both_n, len(list_filter(range(1, 65), lambda i: x[i] or y[i])) as any_n,
  len(list_filter(x, lambda v: v)) + len(list_filter(y, lambda v: v)) as sum_n from raw),
ov as (select vec_id, label, case when label % 2 = 0 then 'local' else 'global' end as edit_scope, case when any_n = 0 then 1 else both_n / any_n::double end as iou,
  case when sum_n = 0 then 1 else 2 * both_n / sum_n::double end as dice from cnt)"""
_SUMMARY_SQL = """count(*) as n, round(avg(iou), 6) as mean_iou, round(avg(dice), 6) as mean_dice, round(quantile_cont(iou, 0.25), 6) as q25, round(quantile_cont(iou, 0.5), 6) as q50,
round(quantile_cont(iou, 0.75), 6) as q75, count(*) filter (where iou >= 0 and iou < 0.2) as bin0, count(*) filter (where iou >= 0.2 and iou < 0.4) as bin1, count(*) filter (where iou >= 0.4 and iou < 0.6) as bin2,
count(*) filter (where iou >= 0.6 and iou < 0.8) as bin3, count(*) filter (where iou >= 0.8 and iou <= 1) as bin4, round(avg(case when iou >= 0.6 then 1.0 else 0.0 end), 6) as frac_iou_06"""
_SUMMARY = ("mean_iou", "mean_dice", "q25", "q50", "q75", "frac_iou_06")


@query(f"with {_OVERLAP_SQL} select vec_id, round(iou, 6) as iou, round(dice, 6) as dice from ov")
def mask_overlap(spark, sf):
    return rounded(_overlaps(spark, sf).select("vec_id", "iou", "dice"), "iou", "dice")


@query(f"with {_OVERLAP_SQL} select {_SUMMARY_SQL} from ov")
def iou_summary(spark, sf):
    return rounded(stats.overlap_summary(_overlaps(spark, sf)), *_SUMMARY)


@query(f"with {_OVERLAP_SQL} select edit_scope, {_SUMMARY_SQL} from (select edit_scope, iou, dice from ov union all select '(all)', iou, dice from ov) group by 1")
def iou_by_scope(spark, sf):
    return rounded(stats.overlap_summary(_overlaps(spark, sf), "edit_scope"), *_SUMMARY)


_POISSON = " + ".join(f"case when u >= {c!r}::double then 1 else 0 end" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712))


@query(f"""with {_OVERLAP_SQL}, rows_ as (select vec_id, iou as a, dice as b, unnest(['(all)', label::varchar]) as "group" from ov),
draw as (select *, ('0x' || substr(md5(concat_ws(':', '5', i, vec_id)), 1, 8))::bigint / 4294967296.0::double as u from (select *, unnest(range(50)) as i from rows_)),
gaps as (select "group", i, sum(({_POISSON}) * (b - a)) / nullif(sum({_POISSON}), 0) as gap from draw group by 1, 2),
ci as (select "group", round(quantile_cont(gap, 0.025), 6) as ci_low, round(quantile_cont(gap, 0.975), 6) as ci_high, round(avg(case when gap <= 0 then 1.0 else 0.0 end), 6) as p_value_one_sided from gaps group by 1)
select r."group", count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(b) - avg(a), 6) as delta, any_value(ci_low) as ci_low, any_value(ci_high) as ci_high,
any_value(p_value_one_sided) as p_value_one_sided from rows_ r join ci using ("group") group by 1""")
def bootstrap_paired(spark, sf):
    found = bootstrap.poisson_bootstrap(_overlaps(spark, sf), "iou", "dice", "vec_id", "label", 50, 5)
    return rounded(found, "mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value_one_sided")


@query(f"""with {_OVERLAP_SQL}, rows_ as (select iou as a, dice as b, unnest(['(all)', label::varchar]) as "group" from ov)
select "group", count(*) as n, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(b - a), 6) as delta, true as near_normal from rows_ group by 1""")
def bootstrap_exact(spark, sf):
    """near_normal: the interval is about the one that the differences' spread gives; the draws themselves are not SQL."""
    pairs = _overlaps(spark, sf).withColumn("label", F.col("label").cast("string"))
    found = bootstrap.grouped_bootstrap(pairs, "iou", "dice", "vec_id", "label", 1000, 5)
    gaps = pairs.select(F.explode(F.array(F.lit("(all)"), F.col("label"))).alias("group"), (F.col("dice") - F.col("iou")).alias("gap"))
    spread = gaps.groupBy("group").agg((F.stddev_pop("gap") / F.sqrt(F.count("gap"))).alias("error"))
    off = lambda end, sign: F.abs(F.col(end) - F.col("delta") - sign * 1.96 * F.col("error"))
    near = (F.greatest(off("ci_low", -1), off("ci_high", 1)) <= 0.8 * F.col("error") + 1e-12) & (F.col("p_value_one_sided") <= 0.5)
    return rounded(found.join(spread, "group").select("group", "n", "mean_a", "mean_b", "delta", near.alias("near_normal")), "mean_a", "mean_b", "delta")


# ---- difficulty, explanations, extraction ----
def _difficulty(spark, sf, config=scores.ScoreConfig()):
    masks = synthetic.mask_artifacts(spark, sf).withColumn("structural_change", F.col("combined_diff_mean"))
    rows = stages.difficulty_stage(synthetic.triplets(spark, sf), masks, config)
    return rows


_DIFFICULTY_SQL = f"""raw_ as (select t.triplet_id, m.mask_area_frac, m.edit_scope, m.spatial_descriptor, combined_diff_mean as structural_change, least(greatest(1 - mask_compactness, 0), 1) as compactness_score,
  {_complexity_sql('instruction')} as instruction_complexity, t.instruction from ({synthetic.TRIPLETS_SQL}) t join masks m using (triplet_id)),
scored as (select *, least(greatest(0.55::double * structural_change + 0.25::double * compactness_score + 0.2::double * instruction_complexity, 0), 1) as difficulty_raw from raw_),
cuts as (select quantile_cont(difficulty_raw, 1/3.0::double) as q33, quantile_cont(difficulty_raw, 2/3.0::double) as q66 from scored),
diff as (select *, case when difficulty_raw <= q33 then 'easy' when difficulty_raw > q66 then 'hard' else 'medium' end as difficulty_bin from scored, cuts)"""


_HAND_LABEL = "case when p_size + 60 * (1 - mask_area_frac) < 45 then 'easy' when p_size + 60 * (1 - mask_area_frac) < 65 then 'medium' else 'hard' end"


@query(f"""with recursive {synthetic.MASKS_SQL}, raw_ as (select least(greatest(combined_diff_mean, 0), 1) as s, least(greatest(1 - mask_area_frac, 0), 1) as l, {_complexity_sql('instruction')} as c,
  case {_HAND_LABEL} when 'easy' then 0 when 'medium' then 1 else 2 end as y
  from ({synthetic.TRIPLETS_SQL}) t join masks m using (triplet_id) join (select concat('part_', p_partkey) as triplet_id, p_size from part) using (triplet_id)),
steps as (select unnest(range(11)) as i), grid as (select a.i / 10.0::double as a, b.i / 10.0::double as b, c.i / 10.0::double as c, (10 - a.i - b.i - c.i) / 10.0::double as d from steps a, steps b, steps c where a.i + b.i + c.i <= 10
  union all select 0.3::double, 0.3::double, 0.2::double, 0.2::double),
scored as (select a, b, grid.c as c, d, y, round(a * s + b * s + grid.c * l + d * raw_.c, 9) as x from raw_, grid),
ranked as (select a, b, c, d, rank() over (partition by a, b, c, d order by x) + (count(*) over (partition by a, b, c, d, x) - 1) / 2.0::double as rx,
  rank() over (partition by a, b, c, d order by y) + (count(*) over (partition by a, b, c, d, y) - 1) / 2.0::double as ry from scored),
fits as (select a, b, c, d, count(*) as n, corr(rx, ry) as rho from ranked group by 1, 2, 3, 4)
select (select count(*) from raw_) as n, round(max(rho), 6) as rho, round(max(rho) filter (where a = 0.3::double and b = 0.3::double and c = 0.2::double), 6) as baseline_rho, true as weights_sum_to_one from fits where not isnan(rho)""")
def calibrated_weights(spark, sf):
    """One round of the search, over the grid of tenths; labels by hand are stood in for by a rule of part size and mask area."""
    rows = _difficulty(spark, sf, scores.ScoreConfig(version=1))
    sizes = table(spark, sf, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("triplet_id"), "p_size")
    labels = rows.select("triplet_id", "mask_area_frac").join(sizes, "triplet_id").select("triplet_id", F.expr(_HAND_LABEL).alias("label"))
    found = calibrate.calibrate(rows, labels, rounds=1)
    whole = abs(sum(found["weights"].values()) - 1) < 1e-9 and min(found["weights"].values()) >= 0
    return rounded(spark.createDataFrame([(found["n"], found["rho"], found["baseline_rho"], whole)], "n bigint, rho double, baseline_rho double, weights_sum_to_one boolean"), "rho", "baseline_rho")


@query(f"with recursive {synthetic.MASKS_SQL}, {_DIFFICULTY_SQL} select triplet_id, round(compactness_score, 9) as compactness_score, round(instruction_complexity, 9) as instruction_complexity, round(difficulty_raw, 9) as difficulty_raw, difficulty_bin from diff")
def difficulty_pipeline(spark, sf):
    found = _difficulty(spark, sf).select("triplet_id", "compactness_score", "instruction_complexity", "difficulty_raw", "difficulty_bin")
    return found.withColumns({c: F.round(c, 9) for c in ("compactness_score", "instruction_complexity", "difficulty_raw")})  # sums of six-digit values have ties at six


def _reasoning(spark, sf):
    masks = synthetic.mask_artifacts(spark, sf)
    return stages.reasoning_stage(synthetic.triplets(spark, sf), masks, _difficulty(spark, sf), _categories(spark, sf))


def _case_sql(key: str, texts: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {_sql_text(v)}" for k, v in texts.items()) + " end"


_STRIPPED = r"regexp_replace(coalesce(instruction, ''), '^\s+|\s+$', '', 'g')"
_CHAIN_SQL = f"""why as (select d.*, c.category, c.confidence, c.source, {_STRIPPED} as said from diff d join cat c using (triplet_id)),
told as (select *, concat('[category=', category, ', scope=', edit_scope, ', difficulty=', difficulty_bin, ', source=', source, ']') as header, concat(
  case when said = '' then '{chain.NO_INSTRUCTION}' else concat('1. The edit instruction states: "', case when length(said) > 200 then concat(substr(said, 1, 197), '...') else said end, '".') end, chr(10),
  '2. The mask of changed pixels covers roughly ', round_even(100 * mask_area_frac, 0)::bigint, '% of the image and ', {_case_sql('spatial_descriptor', chain.SPATIAL_PROSE)}, '.', chr(10),
  '3. Structural change relative to the original is ', case when structural_change < 0.25 then '{chain.MAGNITUDE[0]}' when structural_change > 0.55 then '{chain.MAGNITUDE[2]}' else '{chain.MAGNITUDE[1]}' end,
  ' (SSIM-based score = ', printf('%.2f', structural_change), '), and the edit region is ',
  case when compactness_score < 0.3 then '{chain.COMPACT[0]}' when compactness_score > 0.6 then '{chain.COMPACT[2]}' else '{chain.COMPACT[1]}' end, '.', chr(10),
  '4. The edit is classified as ', category, ', ', case when source = 'dataset_label' then case when confidence >= 0.99 then {_sql_text(chain.EVIDENCE_LABEL)} else '{chain.EVIDENCE_UNMAPPED}' end
    when source = 'rule_based' then replace('{chain.EVIDENCE_RULE}', '{{}}', printf('%.2f', confidence)) else '{chain.EVIDENCE_NONE}' end, '.', chr(10),
  '5. Edits of this type typically exhibit ', {_case_sql('category', chain.PRIORS)}, '.', chr(10),
  '6. Overall, this triplet is ', case difficulty_bin when 'easy' then '{chain.EASY}' when 'hard' then '{chain.HARD}' else '{chain.MEDIUM}' end,
  ' (difficulty score = ', printf('%.2f', difficulty_raw), ', instruction complexity = ', printf('%.2f', instruction_complexity), ').') as chain from why)"""
_REASONING_SQL = f"{synthetic.MASKS_SQL}, {_DIFFICULTY_SQL}, {CATEGORIES_SQL}, {_CHAIN_SQL}"


@query(f"with recursive {_REASONING_SQL} select triplet_id, chain from told")
def chain_text(spark, sf):
    return _reasoning(spark, sf).select("triplet_id", "chain")


@query(f"with recursive {_REASONING_SQL} select triplet_id, header, 'v1.0' as template_version, category, difficulty_bin, spatial_descriptor from told")
def chain_header(spark, sf):
    return _reasoning(spark, sf).drop("chain")


def _first_sql(text: str, phrases) -> str:
    return "case " + " ".join(f"when contains({text}, '{p}') then '{v}'" for p, v in phrases) + " end"


def _extract_sql(text: str) -> str:
    listed = lambda i, allowed: f"case when regexp_extract({text}, '{extract.HEADER}', {i}) in {allowed} then regexp_extract({text}, '{extract.HEADER}', {i}) end"
    return f"""coalesce({listed(1, CATEGORIES)}, {_first_sql(f'lower({text})', extract.category_phrases())}) as pred_category,
{_first_sql(f'lower({text})', extract.SPATIAL_PHRASES)} as pred_spatial_descriptor,
coalesce({listed(3, ('easy', 'medium', 'hard'))}, {_first_sql(f'lower({text})', extract.BIN_PHRASES)}) as pred_difficulty_bin"""


# generated texts: some with a header, some drifted, some cut off
_DRIFT = {0: "concat(header, chr(10), chain)", 1: "replace(chain, '_', ' ')", 2: "upper(chain)", 3: "substr(chain, 1, 150)", 4: "chain"}
_DRIFT_CASE = "case crc % 5 " + " ".join(f"when {k} then {v}" for k, v in _DRIFT.items()) + " end"


def _generated(spark, sf):
    rows = _reasoning(spark, sf).withColumn("crc", F.expr("cast(substr(triplet_id, 6) as int)"))
    return rows.select("triplet_id", F.expr(_DRIFT_CASE).alias("generated_text"))


_GENERATED_SQL = f"{_REASONING_SQL}, gen as (select triplet_id, {_DRIFT_CASE} as generated_text, category, spatial_descriptor, difficulty_bin from (select *, substr(triplet_id, 6)::int as crc from told))"


@query(f"with recursive {_GENERATED_SQL} select triplet_id, {_extract_sql('generated_text')} from gen")
def extract_chain_fields(spark, sf):
    return extract.extract(_generated(spark, sf)).drop("generated_text")


_LABEL_TEXT = """case crc % 6 when 0 then concat('Sure: {"category": "', category, '", "spatial_descriptor": "', spatial_descriptor, '", "difficulty_bin": "', difficulty_bin, '"} done') when 1 then '{"category": 5, "difficulty_bin": "easy"}'
when 2 then '{broken' when 3 then '{not: json}' when 4 then concat('{"category": "', category, '", "difficulty_bin": "Easy"}') else 'no object at all' end"""


@query(f"""with recursive {_REASONING_SQL}, g as (select triplet_id, regexp_extract({_LABEL_TEXT}, '(\\{{[^}}]+\\}})', 1) as j from (select *, substr(triplet_id, 6)::int as crc from told)),
p as (select triplet_id, case when json_valid(j) and j <> '' then j else '{{}}' end as j from g),
f as (select triplet_id, {', '.join(f"case when json_type(j, '$.{n}') = 'VARCHAR' then json_extract_string(j, '$.{n}') end as {n}" for n in extract.FIELDS)} from p)
select triplet_id, case when category in {CATEGORIES} then category end as pred_category, case when spatial_descriptor in {tuple(chain.SPATIAL_PROSE)} then spatial_descriptor end as pred_spatial_descriptor,
case when difficulty_bin in ('easy', 'medium', 'hard') then difficulty_bin end as pred_difficulty_bin from f""")
def extract_label_only(spark, sf):
    rows = _reasoning(spark, sf).withColumn("crc", F.expr("cast(substr(triplet_id, 6) as int)"))
    return extract.extract(rows.select("triplet_id", F.expr(_LABEL_TEXT).alias("generated_text")), "label_only").drop("generated_text")


_MATCH_SQL = """ex as (select *, coalesce(pred_category = category, false) as c, coalesce(pred_spatial_descriptor = spatial_descriptor, false) as s, coalesce(pred_difficulty_bin = difficulty_bin, false) as b
from (select *, {0} from gen))"""


def _evaluated(spark, sf):
    truth = _reasoning(spark, sf).select("triplet_id", "category", "spatial_descriptor", "difficulty_bin")
    return stages.evaluate_predictions(truth, _generated(spark, sf))


@query(f"with recursive {_GENERATED_SQL}, {_MATCH_SQL.format(_extract_sql('generated_text'))} select count(*) as n, round(avg(c::int), 6) as category_accuracy, round(avg(s::int), 6) as spatial_accuracy, round(avg(b::int), 6) as bin_accuracy, round(avg((c and s and b)::int), 6) as joint_accuracy from ex")
def eval_summary(spark, sf):
    return rounded(stats.accuracy_summary(_evaluated(spark, sf)), "category_accuracy", "spatial_accuracy", "bin_accuracy", "joint_accuracy")


@query(f"with recursive {_GENERATED_SQL}, ex as (select {_extract_sql('generated_text')} from gen) select count(*) as n, " + ", ".join(f"round(avg((pred_{n} is not null)::int), 6) as pred_{n}_rate" for n in extract.FIELDS) + " from ex")
def extraction_coverage(spark, sf):
    names = [f"pred_{n}" for n in extract.FIELDS]
    return rounded(stats.coverage(extract.extract(_generated(spark, sf)), names), *[f"{n}_rate" for n in names])


@query(f"""with recursive {_REASONING_SQL} select triplet_id, concat('{{"category": "', category, '", "spatial_descriptor": "', spatial_descriptor, '", "difficulty_bin": "', difficulty_bin, '"}}') as target,
concat('{chain.PROMPT.split('{}')[0].replace(chr(10), "', chr(10), '")}', coalesce(instruction, ''), '"') as prompt from told where category <> 'other'
qualify row_number() over (partition by category, difficulty_bin order by {_SHUFFLE.format(11, 'triplet_id')}, triplet_id) <= 4""")
def training_targets(spark, sf):
    rows = stages.training_rows(synthetic.triplets(spark, sf).select("triplet_id", "instruction"), _reasoning(spark, sf), 4, 11, "label_only")
    return rows.select("triplet_id", "target", "prompt")


# ---- label masks ----
def _token_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    n = (F.col("n_chars") % 20 + 8).cast("int")
    ids = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.when(i > n, 0).when(i.isin(4, 5), i + 100).otherwise((i * 7 + F.col("doc_id")) % 50 + 1).cast("int"))
    rows = docs.select("doc_id", ids.alias("input_ids"), F.lit(0).alias("pad_id"), F.array(F.lit(104), F.lit(105)).alias("marker"))
    return rows.withColumn("labels", labels.label_mask(F.col("input_ids"), F.col("marker"), F.col("pad_id")))


_TOKENS_SQL = """ids as (select doc_id, i, case when i > n_chars % 20 + 8 then 0 when i in (4, 5) then i + 100 else (i * 7 + doc_id) % 50 + 1 end as id
from (select doc_id, n_chars, unnest(range(1, 31)) as i from documents)), lab as (select *, case when i <= 5 or id = 0 then -100 else id end as label from ids)"""


@query(f"with {_TOKENS_SQL} select doc_id, i - 1 as position, id as token, label from lab")
def label_mask_tokens(spark, sf):
    rows = _token_rows(spark, sf).select("doc_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("position", "c"))
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(n) for c, n in (("position", "position"), ("c.input_ids", "token"), ("c.labels", "label"))])


@query(f"""with {_TOKENS_SQL} select doc_id, count(*) filter (where label <> -100) as n_active, count(*) filter (where label = -100) as n_ignored, count(*) filter (where id = 0) as n_pad,
case when count(*) filter (where id = 0) = 0 then 'none' else 'right' end as pad_side, min(id) as least_id, max(id) as largest_id from lab group by 1""")
def batch_diagnostics(spark, sf):
    found = labels.batch_diagnostics(_token_rows(spark, sf)).select("doc_id", "n_active", "n_ignored", "n_pad", "pad_side", "least_id", "largest_id")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("n_active", "n_ignored", "n_pad", "least_id", "largest_id")})


# ---- the flagship: scan, text features, exact bins, cross-tab ----
@query(f"""with d as (select lang, {_complexity_sql('text')} as s from documents), b as (select quantile_cont(s, 1/3.0::double) as q33, quantile_cont(s, 2/3.0::double) as q66 from d),
c as (select lang, {_BINS_SQL} as bin from d, b) select lang, count(*) filter (where bin = 'easy') as easy, count(*) filter (where bin = 'medium') as medium, count(*) filter (where bin = 'hard') as hard from c where lang is not null group by 1""")
def complexity_crosstab(spark, sf):
    rows = table(spark, sf, "documents").select("lang", complexity.complexity(F.col("text")).alias("score"))
    return stats.crosstab(stats.with_tertile_bins(rows, "score"), "lang", "difficulty_bin")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity_crosstab(spark, sf_dir)
