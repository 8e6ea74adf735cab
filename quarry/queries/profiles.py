"""Profiles, distributions, relations and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import format_number
from quarry.operators import aggregate as A
from quarry.operators import facts as X
from quarry.operators import overview as O
from quarry.operators import profile as P
from quarry.operators import relations as R
from quarry.operators import sketches as K
from quarry.operators.filters import quoted
from quarry.plans.flat import FLAT, flat, table
from quarry.plans.spec import Ratio
from quarry.queries.plans import SPINE_SQL, labelled, orders
from quarry.queries.registry import query, register
from quarry.sources.shared import new_folder

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labelled": ["doc_id", "lang", "source", "n_chars", "toxic", "quality", "verdict"],
}
NUMBERS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["event_id", "user_id", "value"]}
LABELLED = "(select d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality, case when l.toxic = 1 then 'bad' when l.toxic = 0 then 'good' end as verdict from documents d left join labels l using (doc_id))"


def source(spark, sf, name):
    return labelled(spark, sf) if name == "labelled" else table(spark, sf, name)


def _from(name):
    return LABELLED if name == "labelled" else name


def _each(name, template, columns=None):
    return " union all ".join(template.format(k=k, c=c, t=_from(name)) for k, c in enumerate(columns or COLUMNS[name]))


for _t in COLUMNS:
    register(
        f"profile_counts_{_t}", _each(_t, "select {k} as position, '{c}' as column, count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as \"unique\", round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) as missing_pct from {t}"),
        lambda spark, sf, t=_t: P.counts(source(spark, sf, t)),
    )

for _t in NUMBERS:
    register(
        f"profile_numbers_{_t}", _each(_t, "select '{c}' as column, cast(min({c}) as double) as minimum, cast(max({c}) as double) as maximum, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, count(*) filter (where {c} = 0) as zeros, count(*) filter (where {c} < 0) as negatives, round(quantile_cont(cast({c} as double), 0.5), 4) as median from {t}", NUMBERS[_t]),
        lambda spark, sf, t=_t: P.numeric_stats(table(spark, sf, t)).withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")}),
    )
    register(
        f"profile_outliers_{_t}", _each(_t, "select '{c}' as column, count({c}) as n, count(*) filter (where {c} < q[1] - 1.5 * (q[2] - q[1]) or {c} > q[2] + 1.5 * (q[2] - q[1])) as outliers, false as too_short from {t}, (select quantile_cont(cast({c} as double), [0.25, 0.75]) as q from {t})", NUMBERS[_t]),
        lambda spark, sf, t=_t: P.outliers(table(spark, sf, t)),
    )

for _t, _dates in (("orders", ["o_orderdate"]), ("lineitem", ["l_shipdate"]), ("events", ["ts"])):
    register(
        f"profile_dates_{_t}", _each(_t, "select '{c}' as column, cast(min({c}) as date) as date_min, cast(max({c}) as date) as date_max from {t}", _dates),
        lambda spark, sf, t=_t: P.date_bounds(table(spark, sf, t)),
    )

TOP_SQL = "select '{c}' as column, rank, value, n from (select value, n, cast(row_number() over (order by n desc, value) as integer) as rank from (select cast({c} as varchar) as value, count(*) as n from {t} where {c} is not null group by 1)) where rank <= 10"
register("profile_top_values", _each("orders", TOP_SQL, ["o_orderstatus", "o_orderpriority"]), lambda spark, sf: P.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))
# Equal counts of long texts are ranked by digest, as in the query.
register(
    "profile_top_texts", "select 'text' as column, rank, value, n from (select value, n, cast(row_number() over (order by n desc, case when length(value) > 64 then 'md5:' || md5(value) else value end) as integer) as rank from (select text as value, count(*) as n from documents where text is not null group by 1)) where rank <= 10",
    lambda spark, sf: P.top_values(table(spark, sf, "documents"), ["text"]),
)
register(
    "profile_samples", _each("lineitem", "select '{c}' as column, rank, value from (select value, cast(row_number() over (order by value) as integer) as rank from (select distinct cast({c} as varchar) as value from {t} where {c} is not null)) where rank <= 5"),
    lambda spark, sf: P.samples(table(spark, sf, "lineitem")),
)

ROLES = {
    "orders": [("o_orderkey", "number", "identifier", None), ("o_custkey", "number", "identifier", None), ("o_orderstatus", "text", "dimension", None), ("o_totalprice", "number", "metric", "sum"), ("o_orderdate", "date", "date", None), ("o_orderpriority", "text", "dimension", None)],
    "lineitem": [("l_orderkey", "number", "identifier", None), ("l_partkey", "number", "identifier", None), ("l_suppkey", "number", "identifier", None), ("l_linenumber", "number", "identifier", None), ("l_quantity", "number", "metric", "sum"), ("l_extendedprice", "number", "metric", "sum"), ("l_discount", "number", "metric", "mean"), ("l_tax", "number", "metric", "mean"), ("l_returnflag", "text", "dimension", None), ("l_linestatus", "text", "dimension", None), ("l_shipdate", "date", "date", None)],
    "events": [("event_id", "number", "identifier", None), ("ts", "date", "date", None), ("user_id", "number", "identifier", None), ("event_type", "text", "dimension", None), ("value", "number", "metric", "sum"), ("props", "text", "dimension", None)],
    "documents": [("doc_id", "number", "identifier", None), ("text", "text", "text", None), ("lang", "text", "dimension", None), ("source", "text", "dimension", None), ("n_chars", "number", "metric", "sum")],
}


def _quote(v):
    return "cast(null as varchar)" if v is None else f"'{v}'"


for _t, _rows in ROLES.items():
    register(
        f"profile_roles_{_t}", " union all ".join(f"select {k} as position, '{c}' as column, '{kind}' as kind, '{role}' as role, {_quote(how)} as default_aggregation" for k, (c, kind, role, how) in enumerate(_rows)),
        lambda spark, sf, t=_t: P.roles(table(spark, sf, t)).drop("unique", "missing_pct"),
    )
register("primary_metric", "select 'l_extendedprice' as primary_metric", lambda spark, sf: P.primary_metric(table(spark, sf, "lineitem")))
register("primary_date", "select 'order_date' as primary_date", lambda spark, sf: P.primary_date(flat(spark, sf).select("ship_date", "order_date", "sales")))
register(
    "rank_dimensions", "with u as (select 'l_returnflag' as column, count(distinct l_returnflag) as \"unique\" from lineitem union all select 'l_linestatus', count(distinct l_linestatus) from lineitem) select cast(row_number() over (order by \"unique\", case \"column\" when 'l_returnflag' then 0 else 1 end) as integer) as rank, \"column\", \"unique\", 4 as band from u",
    lambda spark, sf: P.rank_dimensions(table(spark, sf, "lineitem")),
)


@query("""with e as (select user_id, event_type, props from events), g as (select count(*) as n from e group by user_id, event_type, props)
select cast(sum(n) as bigint) as rows, cast(3 as bigint) as columns, cast(0 as bigint) as missing_cells, 0.0::double as missing_pct, cast(sum(n - 1) as bigint) as duplicate_rows from g""")
def dataset_totals(spark, sf):
    return P.totals(table(spark, sf, "events").select("user_id", "event_type", "props"))


@query(f"select count(*) as rows, cast(7 as bigint) as columns, cast(3 * (count(*) - count(toxic)) as bigint) as missing_cells, round(3 * (count(*) - count(toxic)) / greatest(count(*) * 7, 1) * 100, 2) as missing_pct, cast(0 as bigint) as duplicate_rows from {LABELLED}")
def dataset_totals_missing(spark, sf):
    return P.totals(labelled(spark, sf))


register(
    "describe_orders", " union all ".join(f"select {k} as position, '{c}' as column, '{role}' as role, '{kind}' as kind, count(distinct {c}) as \"unique\", round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) as missing_pct, min(cast({c} as varchar)) as example from orders" for k, (c, kind, role, _) in enumerate(ROLES["orders"])),
    lambda spark, sf: P.describe(table(spark, sf, "orders")),
)
register(
    "missing_pct", _each("labelled", "select '{c}' as column, round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) as missing_pct from {t} having count(*) > count({c})"),
    lambda spark, sf: P.missing_shares(labelled(spark, sf)),
)
register(
    "derived_metrics", "select * from (values ('Profit Margin %', 'profit', 'sales', 100.0::double), ('Average Selling Price', 'sales', 'quantity', 1.0::double), ('Return on Cost %', 'profit', 'cost', 100.0::double)) v(name, numerator, denominator, scale)",
    lambda spark, sf: P.derived_metrics(flat(spark, sf)),
)

CARDS = {"quantity": "sum", "discount": "mean", "tax": "mean", "sales": "sum", "cost": "sum", "profit": "sum"}
RATIOS = [("Profit Margin %", "profit", "sales", 100.0), ("Average Selling Price", "sales", "quantity", 1.0), ("Return on Cost %", "profit", "cost", 100.0)]
_cards = ["select 0 as position, 'Rows' as label, cast(count(*) as double) as value, 'int' as format from flat"]
_cards += [f"select {1 + k}, '{'Avg' if h == 'mean' else 'Total'} {m}', {f'cast(sum({m}) as double) / count({m})' if h == 'mean' else f'cast(sum({m}) as double)'}, 'num' from flat" for k, (m, h) in enumerate(CARDS.items())]
_cards += [f"select {7 + k}, '{n}', cast(sum({a}) as double) / nullif(cast(sum({b}) as double), 0) * {s}, '{'pct' if s == 100 else 'num'}' from flat" for k, (n, a, b, s) in enumerate(RATIOS)]
_cards += ["select 10, 'Distinct region', cast(count(distinct region) as double), 'int' from flat"]
register("kpi_cards", f"with {FLAT} select position, label, round(value, 6) as value, format from ({' union all '.join(_cards)})", lambda spark, sf: P.kpi_cards(flat(spark, sf), CARDS, RATIOS, "region").withColumn("value", F.round("value", 6)))
register(
    "filter_options", "select 'o_orderstatus' as column, o_orderstatus as value from orders group by 2 union all select 'o_orderpriority', o_orderpriority from orders group by 2",
    lambda spark, sf: P.filter_options(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]),
)

# Distributions and relations.

STATISTICS_SQL = "select * from (select unnest(range(8)) as i, unnest(['count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'max']) as statistic, unnest([cast(count({c}) as double), avg({c}), stddev_samp({c}), min({c}), quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75), max({c})]) as v from {t})"
for _name, _t, _c in (("distribution_discount", "lineitem", "l_discount"), ("distribution_value", "events", "value")):
    register(_name, f"select cast(i as integer) as position, statistic, round(v, 3) as value from ({STATISTICS_SQL.format(c=_c, t=_t)})", lambda spark, sf, t=_t, c=_c: R.summary(table(spark, sf, t), c))


@query("select value, n as count from (select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1)")
def value_counts(spark, sf):
    return R.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("""with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
c as (select least(cast(floor((l_extendedprice - lo) * 40 / (hi - lo)) as bigint) + 1, 40) as bin, count(*) as n from lineitem, e group by 1)
select bin, round(lo + (bin - 1) * ((hi - lo) / 40), 6) as low, round(lo + bin * ((hi - lo) / 40), 6) as high, coalesce(n, 0) as count from e, (select unnest(range(1, 41)) as bin) left join c using (bin)""")
def histogram40(spark, sf):
    return R.histogram(table(spark, sf, "lineitem"), "l_extendedprice").withColumns({c: F.round(c, 6) for c in ("low", "high")})


BOX_SQL = """with q as (select {k} as k, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75 from events group by 1)
select {out} round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75, min(value) filter (where value >= p25 - 1.5 * (p75 - p25) and value <= p75 + 1.5 * (p75 - p25)) as whisker_low,
  max(value) filter (where value >= p25 - 1.5 * (p75 - p25) and value <= p75 + 1.5 * (p75 - p25)) as whisker_high, count(*) filter (where not (value >= p25 - 1.5 * (p75 - p25) and value <= p75 + 1.5 * (p75 - p25))) as outliers
from events join q on {k} = q.k group by q.k, p25, p50, p75"""
QUARTERS = ("p25", "p50", "p75")
register("box_by_event", BOX_SQL.format(k="event_type", out="q.k as event_type,"), lambda spark, sf: R.box(table(spark, sf, "events"), "value", ["event_type"]).withColumns({c: F.round(c, 6) for c in QUARTERS}))
register("box_all", BOX_SQL.format(k="1", out=""), lambda spark, sf: R.box(table(spark, sf, "events"), "value").withColumns({c: F.round(c, 6) for c in QUARTERS}))
register("pearson", "select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem where l_quantity is not null and l_extendedprice is not null", lambda spark, sf: R.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6)))

MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRENGTH_SQL = "case when abs(r) > 0.8 then 'very strong' when abs(r) > 0.6 then 'strong' when abs(r) > 0.35 then 'moderate' when abs(r) > 0.15 then 'weak' when r is not null then 'negligible' end as strength"
_cells = [f"select '{a}' as column_a, '{b}' as column_b, {f'case when stddev_pop({a}) > 0 then 1.0::double end' if a == b else f'round(corr({a}, {b}), 3) + 0.0'} as r from lineitem" for a in MATRIX for b in MATRIX]
_cells += [f"select '{a}', '{b}', cast(null as double) from lineitem having count(*) >= 0" for a, b in [("one", "one"), *[x for m in MATRIX for x in ((m, "one"), ("one", m))]]]
register("correlation_matrix", f"select column_a, column_b, r, {STRENGTH_SQL} from ({' union all '.join(_cells)})", lambda spark, sf: R.correlations(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), [*MATRIX, "one"]))


POINT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_draw = lambda keys: f"md5(concat_ws(chr(31), {', '.join(f"coalesce('v' || {k}, 'n')" for k in keys)}))"


@query(f"select {', '.join(POINT)}, l_quantity, l_extendedprice, l_returnflag from lineitem where l_quantity is not null and l_extendedprice is not null order by {_draw(POINT)}, {', '.join(POINT)}, l_quantity, l_extendedprice, l_returnflag limit 5000")
def scatter_sample(spark, sf):
    return R.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", POINT, "l_returnflag")


@query(f"select * from orders order by {_draw(['o_orderkey'])}, o_orderkey limit 500")
def steady_sample(spark, sf):
    return A.steady_sample(table(spark, sf, "orders"), ["o_orderkey"], 500)


@query("select count(*) as n from (select o_orderkey from orders limit 500)")
def steady_sample_size(spark, sf):
    return A.steady_sample(table(spark, sf, "orders"), ["o_orderkey"], 500).agg(F.count("*").alias("n"))


@query("""select round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(stddev_samp(value), 6) as std,
  case when abs(avg(value) - quantile_cont(value, 0.5)) < 0.5 * (case when coalesce(stddev_samp(value), 0) = 0 then 1 else stddev_samp(value) end) then 'symmetric' else 'skewed' end as shape from events""")
def skew_hint(spark, sf):
    return R.skew_hint(table(spark, sf, "events"), "value").withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


# Facts.


@query(f"""with {FLAT}, r as (select nation, cast(sum(sales) as double) as value from flat group by nation), t as (select *, row_number() over (order by value desc, nation) as k from r order by k limit 10)
select max(nation) filter (where k = 1) as leader, max(nation) filter (where k = 2) as runner_up, round((max(value) filter (where k = 1) - max(value) filter (where k = 2)) / nullif(abs(max(value) filter (where k = 2)), 0) * 100, 1) as gap_pct,
  round(max(value) filter (where k = 1) / nullif(sum(value), 0) * 100, 1) as leader_share_pct, arg_max(nation, k) as lowest, arg_max(value, k) as lowest_value from t""")
def ranking_facts(spark, sf):
    top = A.ranked(A.grouped(flat(spark, sf), "sales", "sum", ["nation"]), ["nation"], limit=10)
    return X.ranking_facts(top, "nation")


METRICS = ["quantity", "discount", "tax", "sales", "cost", "profit"]
register(
    "metric_totals", f"with {FLAT} " + " union all ".join(f"select '{m}' as metric, cast(sum({m}) as double) as total, round(cast(sum({m}) as double) / count({m}), 6) as average, cast(min({m}) as double) as minimum, cast(max({m}) as double) as maximum from flat" for m in METRICS),
    lambda spark, sf: X.metric_totals(flat(spark, sf), METRICS).withColumn("average", F.round("average", 6)),
)

DIMENSIONS = ["region", "segment", "priority", "status", "nation", "brand", "part_type"]
_dims = " union all ".join(f"select '{d}' as dimension, {d} as label, cast(sum(sales) as double) as value from flat where {d} is not null group by {d}" for d in DIMENSIONS)
register(
    "top3_per_dimension", f"with {FLAT}, g as ({_dims}), r as (select *, cast(row_number() over (partition by dimension order by value desc, label) as integer) as rank, sum(value) over (partition by dimension) as total from g) select dimension, rank, label, value, case when rank = 1 then round(value / nullif(total, 0) * 100, 1) end as leader_share_pct from r where rank <= 3",
    lambda spark, sf: X.top_by_dimension(flat(spark, sf), "sales", DIMENSIONS),
)


@query("""with g as (select 's_name' as dimension, s_name as label, cast(sum(cast(s_acctbal as decimal(12,2))) as double) as value from supplier group by s_name
  union all select 's_nationkey', cast(s_nationkey as varchar), cast(sum(cast(s_acctbal as decimal(12,2))) as double) from supplier group by s_nationkey)
select dimension, first(label order by value, label) as label, min(value) as value from g group by dimension having min(value) < 0""")
def negative_laggards(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(12,2)"))
    return X.negative_laggards(rows, "s_acctbal", ["s_name", "s_nationkey"])


@query(f"""with {SPINE_SQL.format('year')}, m as (select strftime(cast(o_orderdate as date), '%Y-%m') as period, cast(sum(cast(o_totalprice as decimal(14,2))) as double) as value from orders group by 1),
z as (select period, round((value - avg(value) over ()) / stddev_samp(value) over (), 2) as z from m)
select 0 as ord, 'yearly' as kind, strftime(start, '%Y') as key, value from filled union all select 1, 'anomaly', period, z from z where abs(z) >= 2
union all select 2, 'missing', 'all', 0.0 from orders having count(*) >= 0""")
def summary_facts(spark, sf):
    from quarry.operators import timeseries as S

    rows = orders(spark, sf)
    missing = P.totals(table(spark, sf, "orders")).withColumn("key", F.lit("all"))
    return X.facts_table([("yearly", X.yearly_facts(rows, "o_orderdate", "price"), "period", "value"), ("anomaly", S.anomalies(rows, "o_orderdate", "price"), "period", "z_score"), ("missing", missing, "key", "missing_pct")])


@query(f"with {FLAT} select part_type, cast(sum(profit) as double) as value from flat group by part_type order by value desc, part_type limit 10")
def top_categories(spark, sf):
    return X.top_categories(flat(spark, sf), "part_type", "profit")


@query(f"""with {FLAT}, v as (select nation, cast(sum(sales) as double) as value, count(*) as n, cast(sum(profit) as double) / cast(sum(sales) as double) * 100 as margin from flat group by nation)
select nation, case when abs(value) >= 1e9 then format('{{:,.2f}}B', value / 1e9) when abs(value) >= 1e6 then format('{{:,.2f}}M', value / 1e6) when abs(value) >= 1e3 then format('{{:,.0f}}', value) else format('{{:,.2f}}', value) end as sales, format('{{:,}}', n) as orders, format('{{:,.1f}}%', margin) as margin from v""")
def format_numbers(spark, sf):
    rows = flat(spark, sf).groupBy("nation").agg(F.sum("sales").cast("double").alias("value"), F.count("*").alias("n"), (F.sum("profit").cast("double") / F.sum("sales").cast("double") * 100).alias("m"))
    return rows.select("nation", format_number(quoted("value")).alias("sales"), format_number(quoted("n"), "int").alias("orders"), format_number(quoted("m"), "pct").alias("margin"))


_pairs = [(a, b) for i, a in enumerate(CARDS) for b in list(CARDS)[i + 1 :]]
_top = " union all ".join(f"select '{d}' as d, {k} as k, {d} as label, cast(sum(sales) as double) as value from flat group by {d}" for k, d in enumerate(DIMENSIONS))
OVERVIEW_SQL = f"""with {FLAT}, c as ({' union all '.join(_cards)}),
ends as (select cast(min(sales) as double) as lo, cast(max(sales) as double) as hi from flat),
bins as (select least(cast(floor((cast(sales as double) - lo) * 40 / (hi - lo)) as bigint) + 1, 40) as bin, count(*) as n from flat, ends group by 1),
months as (select strftime(order_date, '%Y-%m') as period, cast(sum(sales) as double) as value from flat group by 1),
spine as (select strftime(unnest(generate_series(min(date_trunc('month', order_date)), max(date_trunc('month', order_date)), interval 1 month)), '%Y-%m') as period from flat),
filled as (select period, coalesce(value, 0) as value from spine left join months using (period)),
z as (select period, round((value - avg(value) over ()) / stddev_samp(value) over (), 2) as z from filled),
top as (select *, row_number() over (partition by d order by value desc, label) as rank from ({_top}))
select 0 as ord, 'card' as kind, label as key, round(value, 4) as value from c
union all select 1, 'month', period, round(value, 4) from filled union all select 2, 'top', d || '|' || rank || '|' || label, round(value, 4) from top where rank <= 10
union all select 3, 'bin', cast(bin as varchar), coalesce(n, 0) from (select unnest(range(1, 41)) as bin) left join bins using (bin)
{' '.join(f"union all select 4, 'correlation', '{a}|{b}', round(corr({a}, {b}), 3) + 0.0 from flat" for a, b in _pairs)}
union all select 6, 'anomaly', period, z from z where abs(z) >= 2"""


@query(OVERVIEW_SQL)
def overview(spark, sf):
    ratios = [(name, Ratio(a, b, s)) for name, a, b, s in RATIOS]
    return O.overview(flat(spark, sf), CARDS, ratios, "sales", "order_date", DIMENSIONS).withColumn("value", F.round("value", 4))


@query(f"select 0 as ord, 'card' as kind, 'Rows' as key, count(*)::double as value from {LABELLED} union all select 0, 'card', 'Total n_chars', sum(n_chars)::double from {LABELLED} union all select 0, 'card', 'Distinct verdict', count(distinct verdict)::double from {LABELLED} union all select 5, 'missing', k, round(100 * (count(*) - count(v)) / count(*), 2) from (select unnest(['toxic', 'quality', 'verdict']) as k, unnest([toxic::varchar, quality::varchar, verdict]) as v from {LABELLED}) group by k having count(*) > count(v)")
def overview_missing(spark, sf):
    return O.overview(labelled(spark, sf), {"n_chars": "sum"}, dimensions=["verdict"]).where("kind in ('card', 'missing')")


def halves(spark, sf):
    """The sketches of the order lines, kept in two batches by return flag."""
    store = K.ProfileStore(spark, f"{new_folder(spark, 'profile')}/sketches")
    rows = table(spark, sf, "lineitem")
    store.add(rows.where("l_returnflag = 'N'"))
    store.add(rows.where("l_returnflag <> 'N'"))
    return store.merged()


register(
    "sketch_counts", _each("lineitem", "select '{c}' as column, count(*) as rows, count(*) - count({c}) as missing, true as distinct_within, true as median_within from {t}"),
    lambda spark, sf: sketch_errors(spark, sf),
)


def sketch_errors(spark, sf):
    """Merged sketches beside the exact profile: whether they are as near as they say. A median's rank is exact for the sketch's value."""
    rows = table(spark, sf, "lineitem")
    about = K.profile(halves(spark, sf)).collect()  # one row a column
    exact = P.counts(rows).select("column", "unique")
    ranks = rows.agg(*(F.struct(F.avg((F.col(r["column"]) < r["p50_about"]).cast("int")).alias("lo"), F.avg((F.col(r["column"]) <= r["p50_about"]).cast("int")).alias("hi")).alias(r["column"]) for r in about if r["p50_about"] is not None)).first()
    said = [(r["column"], r["rows"], r["missing"], float(r["distinct_about"]), r["p50_about"] is None or ranks[r["column"]]["lo"] - K.RANK_ERROR <= 0.5 <= ranks[r["column"]]["hi"] + K.RANK_ERROR) for r in about]
    held = spark.createDataFrame(said, "column string, rows long, missing long, about double, median_within boolean")
    return held.join(exact, "column").select("column", "rows", "missing", (F.abs(F.col("about") - F.col("unique")) <= K.DISTINCT_ERROR * F.col("unique") + 0.5).alias("distinct_within"), "median_within")


register(
    "sketch_top_values", " union all ".join(TOP_SQL.format(c=c, t="lineitem") for c in ("l_returnflag", "l_linestatus", "l_linenumber")),
    lambda spark, sf: K.top_values(halves(spark, sf).where("column in ('l_returnflag', 'l_linestatus', 'l_linenumber')")),
)


register(
    "profile_roles_from_sketches", " union all ".join(f"select '{t}' as dataset, {k} as position, '{c}' as column, '{kind}' as kind, '{role}' as role, {_quote(how)} as default_aggregation, round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) as missing_pct, true as unique_within from {t}" for t, rows in ROLES.items() for k, (c, kind, role, how) in enumerate(rows)),
    lambda spark, sf: _roles_from_sketches(spark, sf),
)


def _roles_from_sketches(spark, sf):
    parts = []
    for t in ROLES:
        rows = table(spark, sf, t)
        exact = P.counts(rows).select("column", F.col("unique").alias("exact"))
        near = (F.abs(F.col("unique") - F.col("exact")) <= K.DISTINCT_ERROR * F.col("exact") + 0.5).alias("unique_within")
        parts.append(P.roles(rows, approx=True).join(exact, "column").select(F.lit(t).alias("dataset"), "position", "column", "kind", "role", "default_aggregation", "missing_pct", near))
    return reduce(DataFrame.unionByName, parts)
