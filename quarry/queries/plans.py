"""Aggregates, rankings, ratios, trends and filters over the flat view and single tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import facts as X
from quarry.operators import timeseries as S
from quarry.operators.filters import apply_filters, candidates, closest_bound, drop_nulls, evidence
from quarry.plans.execute import run
from quarry.plans.flat import FLAT, flat, table
from quarry.plans.spec import Filter, Ratio, Spec
from quarry.queries.registry import query, register

AGGREGATE_SQL = {
    "sum": "cast(coalesce(sum(sales), 0) as double)", "mean": "cast(sum(sales) as double) / count(sales)", "median": "round(quantile_cont(cast(sales as double), 0.5), 4)",
    "count": "count(sales)", "min": "cast(min(sales) as double)", "max": "cast(max(sales) as double)", "nunique": "count(distinct sales)", "std": "round(stddev_samp(cast(sales as double)), 4)",
}


def _tidy(df, how):
    if how in ("median", "std"):
        return df.withColumn("value", F.round("value", 4))
    return df.withColumn("value", F.col("value").cast("double")) if how in ("min", "max") else df


for _how, _sql in AGGREGATE_SQL.items():
    register(
        f"agg_{_how}_by_segment", f"with {FLAT} select segment, {_sql} as value from flat where segment is not null group by segment",
        lambda spark, sf, how=_how: _tidy(run(flat(spark, sf), Spec(metric="sales", aggregation=how, dimensions=("segment",))).table, how),
    )
    register(
        f"agg_{_how}_total", f"with {FLAT} select {_sql.replace('count(sales)', 'count(*)') if _how == 'count' else _sql} as value from flat",
        lambda spark, sf, how=_how: _tidy(run(flat(spark, sf), Spec(metric="sales", aggregation=how)).table, how),
    )


@query(f"with {FLAT} select cast(sum(sales) as double) as total_sales from flat")
def total_sales(spark, sf):
    return A.scalar(flat(spark, sf), "sales", "sum", "total_sales")


@query(f"with {FLAT} select region, cast(sum(profit) as double) as value from flat group by region order by value desc, region limit 3")
def top_region_profit(spark, sf):
    return run(flat(spark, sf), Spec.from_dict({"intent": "topn", "metric": "Profit", "dimensions": ["Region"], "limit": 3})).table


@query(f"with {FLAT} select customer, cast(sum(sales) as double) as value from flat group by customer order by value desc, customer limit 10")
def top10_customers(spark, sf):
    return run(flat(spark, sf), Spec(intent="topn", metric="sales", dimensions=("customer",))).table


@query(f"with {FLAT} select part_type, cast(sum(profit) as double) as value from flat group by part_type order by value, part_type limit 1")
def bottom_part_type(spark, sf):
    return run(flat(spark, sf), Spec(intent="topn", metric="profit", dimensions=("part_type",), sort="asc", limit=1)).table


@query(f"with {FLAT} select region, segment, cast(sum(sales) as double) as value from flat group by region, segment")
def sales_by_region_segment(spark, sf):
    return run(flat(spark, sf), Spec(metric="sales", dimensions=("region", "segment"))).table


@query("select l.toxic as toxic, cast(coalesce(sum(d.n_chars), 0) as double) as value from documents d left join labels l using (doc_id) where l.toxic is not null group by l.toxic")
def agg_null_keys_dropped(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return A.grouped(docs, "n_chars", "sum", ["toxic"])


@query("select lang, cast(coalesce(sum(case when l.toxic = 9 then 1.0 end), 0) as double) as total, count(l.quality) as labelled from documents d left join labels l using (doc_id) group by lang")
def agg_all_null_group(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("nothing", F.when(F.col("toxic") == 9, 1.0))
    return A.grouped(docs, "nothing", "sum", ["lang"], "total").join(A.grouped(docs, "quality", "count", ["lang"], "labelled"), "lang")


MARGIN = Ratio("profit", "sales", 100)


@query(f"with {FLAT} select region, round(cast(sum(profit) as double) / nullif(cast(sum(sales) as double), 0) * 100, 6) as value from flat group by region")
def margin_by_region(spark, sf):
    return run(flat(spark, sf), Spec(dimensions=("region",), ratio=MARGIN)).table.withColumn("value", F.round("value", 6))


@query(f"with {FLAT} select round(cast(sum(profit) as double) / nullif(cast(sum(sales) as double), 0) * 100, 6) as value from flat")
def margin_total(spark, sf):
    return run(flat(spark, sf), Spec(ratio=MARGIN)).table.withColumn("value", F.round("value", 6))


@query(f"with {FLAT} select brand, round(cast(sum(sales) as double) / nullif(cast(sum(quantity) as double), 0), 6) as value from flat group by brand")
def price_by_brand(spark, sf):
    return run(flat(spark, sf), Spec(dimensions=("brand",), ratio=Ratio("sales", "quantity"))).table.withColumn("value", F.round("value", 6))


@query(f"""with {FLAT} select discount, round(value, 6) as value from (
  select cast(discount as double) as discount, cast(sum(sales) as double) / nullif(cast(sum(case when discount = 0 then 0 else discount end) as double), 0) as value from flat group by discount) where value is not null""")
def ratio_zero_denominator(spark, sf):
    rows = flat(spark, sf).withColumn("discount_key", F.col("discount").cast("double"))
    return A.grouped_ratio(rows, Ratio("sales", "discount"), ["discount_key"]).select(F.col("discount_key").alias("discount"), F.round("value", 6).alias("value"))


@query("select cast(null as double) as value from lineitem where l_discount = 0 having count(*) >= 0")
def ratio_zero_total(spark, sf):
    return A.scalar_ratio(table(spark, sf, "lineitem").where("l_discount = 0"), Ratio("l_extendedprice", "l_discount"))


@query(f"""with {FLAT} select region, cast(coalesce(sum(sales), 0) as double) as value from flat where strftime(order_date, '%Y') in ('1996', '1997') group by region""")
def compare_years(spark, sf):
    rows = S.with_period(flat(spark, sf), "order_date", "year")
    return run(rows, Spec(intent="compare", metric="sales", dimensions=("region",), filters=(Filter("period", "in", ["1996", "1997"]),))).table


# Trends.

PERIOD_SQL = {
    "day": "strftime({0}, '%Y-%m-%d')", "week": "strftime(date_trunc('week', {0}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {0}) + interval 6 day, '%Y-%m-%d')",
    "month": "strftime({0}, '%Y-%m')", "quarter": "strftime({0}, '%Y') || 'Q' || cast(quarter({0}) as varchar)", "year": "strftime({0}, '%Y')",
}
CHANGE_SQL = "round(value - lag(value) over (order by period), 2) + 0.0 as change, round((value - lag(value) over (order by period)) / nullif(lag(value) over (order by period), 0) * 100, 1) + 0.0 as change_pct"
ORDERS = "select *, cast(o_totalprice as decimal(14,2)) as price from orders"


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(14,2)"))


for _grain, _sql in PERIOD_SQL.items():
    register(
        f"trend_{_grain}", f"with s as (select {_sql.format('o_orderdate')} as period, cast(sum(price) as double) as value from ({ORDERS}) group by 1) select period, value, {CHANGE_SQL} from s",
        lambda spark, sf, grain=_grain: run(orders(spark, sf), Spec(intent="trend", metric="price", date="o_orderdate", grain=grain)).table,
    )


@query(f"with {FLAT} select strftime(order_date, '%Y-%m') as period, region, cast(sum(sales) as double) as value from flat group by 1, 2")
def trend_month_by_region(spark, sf):
    return run(flat(spark, sf), Spec(intent="trend", metric="sales", dimensions=("region",), date="order_date", grain="monthly")).table


@query(f"with {FLAT}, s as (select strftime(order_date, '%Y') as period, cast(sum(profit) as double) / nullif(cast(sum(sales) as double), 0) * 100 as value from flat group by 1) select period, round(value, 6) as value, {CHANGE_SQL} from s")
def trend_margin_year(spark, sf):
    return S.trend(flat(spark, sf), "order_date", "year", ratio=MARGIN).withColumn("value", F.round("value", 6))


SPINE_SQL = """days as (select cast(o_orderdate as date) as day, sum(cast(o_totalprice as decimal(14,2))) as v from orders group by 1),
  spine as (select cast(unnest(generate_series(date_trunc('{0}', min(day)), date_trunc('{0}', max(day)), interval 1 {0})) as date) as start from days),
  filled as (select start, cast(coalesce(sum(v), 0) as double) as value from spine left join days on date_trunc('{0}', day) = start group by start)"""


@query(f"with {SPINE_SQL.format('day')} select strftime(start, '%Y-%m-%d') as period, value from filled")
def daily_filled(spark, sf):
    return S.calendar(orders(spark, sf), "o_orderdate", "price", "day").select("period", "value")


@query(f"with {SPINE_SQL.format('month')} select strftime(start, '%Y-%m') as period, value from filled")
def monthly_filled(spark, sf):
    return S.calendar(orders(spark, sf), "o_orderdate", "price", "month").select("period", "value")


ANOMALY_SQL = """select period, value, z_score, case when z_score > 0 then 'above' else 'below' end as direction, false as too_short from (
  select {1} as period, value, round((value - avg(value) over ()) / nullif(stddev_samp(value) over (), 0), 2) as z_score, count(*) over () as n from {0}) where abs(z_score) >= 2 and n >= 6"""


@query(f"with {SPINE_SQL.format('month')} {ANOMALY_SQL.format('filled', "strftime(start, '%Y-%m')")}")
def anomalies_monthly(spark, sf):
    return S.anomalies(orders(spark, sf), "o_orderdate", "price")


@query(f"with filled as (select date_trunc('day', ts) as start, cast(sum(cast(value as decimal(18,6))) as double) as value from events group by 1) {ANOMALY_SQL.format('filled', "strftime(start, '%Y-%m-%d')")}")
def anomalies_daily(spark, sf):
    events = table(spark, sf, "events").withColumn("amount", F.col("value").cast("decimal(18,6)"))
    return S.anomalies(events, "ts", "amount", "day")


@query(f"""with s as (select strftime(o_orderdate, '%Y-%m') as period, cast(sum(price) as double) as value from ({ORDERS}) group by 1)
select first(value order by period) as first_value, last(value order by period) as last_value, round((last(value order by period) - first(value order by period)) / nullif(abs(first(value order by period)), 0) * 100, 1) as change_pct,
  first(period order by value desc, period) as peak_period, max(value) as peak_value, first(period order by value, period) as low_period, min(value) as low_value, round(sum(value), 2) as total from s""")
def series_facts(spark, sf):
    series = A.grouped(S.with_period(orders(spark, sf), "o_orderdate", "month"), "price", "sum", ["period"])
    return S.series_facts(series).withColumn("total", F.round("total", 2))


@query(f"with {SPINE_SQL.format('year')} select strftime(start, '%Y') as period, value, round((last(value) over w - first(value) over w) / nullif(abs(first(value) over w), 0) * 100, 1) as overall_change_pct from filled window w as (order by start rows between unbounded preceding and unbounded following)")
def yearly_facts(spark, sf):
    return X.yearly_facts(orders(spark, sf), "o_orderdate", "price")


# Filters. Labels are missing for most documents, so their columns hold nulls.

LABELLED = "(select d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality, case when l.toxic = 1 then 'bad' when l.toxic = 0 then 'good' end as verdict from documents d left join labels l using (doc_id))"


def labelled(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", "lang", "source", "n_chars", "toxic", "quality", F.when(F.col("toxic") == 1, "bad").when(F.col("toxic") == 0, "good").alias("verdict"))


for _name, _filter, _sql in (
    ("eq", Filter("verdict", "==", "bad"), "verdict = 'bad'"),
    ("eq_default", Filter("quality", value=1), "quality = 1"),
    ("ne", Filter("verdict", "!=", "bad"), "verdict is distinct from 'bad'"),
    ("gt", Filter("toxic", ">", "0"), "toxic > 0"),
    ("lt", Filter("toxic", "<", 1), "toxic < 1"),
    ("ge", Filter("n_chars", ">=", 1000), "n_chars >= 1000"),
    ("le", Filter("n_chars", "<=", 500), "n_chars <= 500"),
    ("in", Filter("verdict", "in", ["bad", "good"]), "verdict in ('bad', 'good')"),
    ("notin", Filter("verdict", "not in", ["bad"]), "coalesce(verdict not in ('bad'), true)"),
    ("contains", Filter("source", "contains", "RC1"), "regexp_matches(source, '(?i)RC1')"),
    ("contains_number", Filter("n_chars", "contains", "99$"), "regexp_matches(cast(n_chars as varchar), '99$')"),
    ("between", Filter("n_chars", "between", [200, 2000]), "n_chars between 200 and 2000"),
    ("fuzzy_snap", Filter("verdict", "==", "Goood"), "verdict = 'good'"),
):
    register(f"filter_{_name}", f"select doc_id, verdict, n_chars from {LABELLED} where {_sql}", lambda spark, sf, f=_filter: apply_filters(labelled(spark, sf), [f]).df.select("doc_id", "verdict", "n_chars"))


@query("select o_orderkey from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1996-03-31'")
def filter_between_dates(spark, sf):
    return apply_filters(table(spark, sf, "orders"), [Filter("o_orderdate", "between", ["1996-01-01", "1996-03-31"])]).df.select("o_orderkey")


@query("select o_orderkey from orders where regexp_matches(cast(cast(o_totalprice as decimal(18,2)) as varchar), '^1234')")
def filter_contains_price(spark, sf):
    return apply_filters(table(spark, sf, "orders"), [Filter("o_totalprice", "contains", "^1234")]).df.select("o_orderkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' and o_totalprice > 1000")
def filter_skip_empty(spark, sf):
    filters = [Filter("o_orderstatus", "==", "F"), Filter("o_totalprice", "<", -1), Filter("o_orderpriority", "between", ["x"]), Filter("o_totalprice", ">", 1000), Filter("o_orderstatus", "contains", "(")]
    return apply_filters(table(spark, sf, "orders"), filters).df.select("o_orderkey", "o_orderstatus")


@query(f"select doc_id, toxic from {LABELLED} where toxic is not null")
def drop_null_rows(spark, sf):
    return drop_nulls(labelled(spark, sf), ["doc_id", "toxic"])


@query("""select count(*) as rows_in_dataset, count(*) filter (where f) as rows_after_filters, cast(min(o_orderdate) filter (where f) as date) as date_min, cast(max(o_orderdate) filter (where f) as date) as date_max,
'o_orderstatus == F; o_totalprice between 1000 and 200000' as filters, 'o_totalprice, o_orderstatus, o_orderdate' as columns_used from (select *, o_orderstatus = 'F' and o_totalprice between 1000 and 200000 as f from orders)""")
def evidence_counts(spark, sf):
    rows = table(spark, sf, "orders")
    applied = apply_filters(rows, [Filter("o_orderstatus", "==", "f"), Filter("o_totalprice", "between", [1000, 200000])]).applied
    return evidence(rows, applied, "o_orderdate", used=["o_totalprice"]).withColumns({c: F.concat_ws(s, c) for c, s in (("filters", "; "), ("columns_used", ", "))})


WANTED = "small widgit"
_letters = " + ".join(f"least({WANTED.count(c)}, length(v) - length(replace(v, '{c}', '')))" for c in sorted(set(WANTED)))


@query(f"""select p_name as value, round(2.0 * ({_letters}) / ({len(WANTED)} + length(v)), 6) as bound from (select distinct p_name, lower(p_name) as v from part where p_name is not null)
where 2.0 * least({len(WANTED)}, length(v)) / ({len(WANTED)} + length(v)) >= 0.85 - 1e-9 and 2.0 * ({_letters}) / ({len(WANTED)} + length(v)) >= 0.85 - 1e-9""")
def category_candidates(spark, sf):
    """The names that a misspelled one is compared with."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("value")).where("value is not null").distinct()
    return candidates(names, [WANTED]).select("value", F.round(closest_bound(F.col("low"), WANTED), 6).alias("bound"))


@query("select * from customer where c_custkey in (9007199254740993, 7, 12) or c_custkey between 1400 and 1404")
def filter_long_numbers(spark, sf):
    rows = table(spark, sf, "customer")
    far = apply_filters(rows, [Filter("c_custkey", "in", ["9007199254740993", 7, "12.0"])], snap=False).df
    return far.unionByName(apply_filters(rows, [Filter("c_custkey", "between", ["1400", 1404.0])], snap=False).df)


@query("select o_orderstatus as value, count(*) as count from orders group by 1")
def spec_distribution_of_text(spark, sf):
    return run(table(spark, sf, "orders"), Spec(intent="distribution", metric="o_orderstatus")).table


@query("select * from orders order by o_orderdate desc, o_orderkey limit 40")
def spec_rows_by_date(spark, sf):
    return run(table(spark, sf, "orders"), Spec(intent="rows", metric="o_orderdate", limit=40), keys=("o_orderkey",)).table


@query("select strftime(o_orderdate, '%Y-%m') as \"period 2\", o_orderpriority as period, count(o_orderkey) as value from orders group by 1, 2")
def trend_by_period_column(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "period")
    return run(rows, Spec(intent="trend", metric="o_orderkey", aggregation="count", dimensions=("period",), date="o_orderdate")).table


@query("select * from orders order by o_totalprice desc, o_orderkey limit 25")
def rows_top25(spark, sf):
    return run(table(spark, sf, "orders"), Spec(intent="rows", metric="o_totalprice"), keys=("o_orderkey",)).table


@query("select * from customer order by c_acctbal, c_custkey limit 7")
def rows_lowest7(spark, sf):
    return run(table(spark, sf, "customer"), Spec(intent="rows", metric="c_acctbal", sort="asc", limit=7), keys=("c_custkey",)).table
