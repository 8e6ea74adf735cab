"""Small frames for null keys, ties, empty tables and other traps."""

from __future__ import annotations

import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import extract_json, format_number, strip_reasoning
from quarry.operators import aggregate as A
from quarry.operators import clean as C
from quarry.operators import facts as X
from quarry.operators import profile as P
from quarry.operators import relations as R
from quarry.operators import retrieval as V
from quarry.operators import timeseries as S
from quarry.operators.filters import apply_filters
from quarry.operators.quantiles import exact_quantiles
from quarry.plans.execute import run
from quarry.plans.spec import Filter, Ratio, Spec, merge_filters, resolve, validate
from quarry.sources import delimited as D
from quarry.sources import export as E

ROWS = [("a", 1, 10.0), ("a", 2, None), ("b", 3, -5.0), ("c", 4, None), (None, 5, 7.0), ("b", 6, -5.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, n long, v double").cache()


def as_dict(df, key="k", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_groups_leave_out_null_keys_and_sum_nothing_to_zero(rows):
    assert as_dict(A.grouped(rows, "v", "sum", ["k"])) == {"a": 10.0, "b": -10.0, "c": 0.0}
    assert as_dict(A.grouped(rows, "v", "count", ["k"])) == {"a": 1, "b": 2, "c": 0}
    assert as_dict(A.grouped(rows, "v", "median", ["k"])) == {"a": 10.0, "b": -5.0, "c": None}
    assert as_dict(A.grouped(rows, "v", "std", ["k"])) == {"a": None, "b": 0.0, "c": None}
    assert A.scalar(rows, "v", "count").first()["value"] == 6


def test_ranking_breaks_ties_and_puts_nulls_last(spark, rows):
    means = A.grouped(rows, "v", "mean", ["k"])
    assert [r["k"] for r in A.ranked(means, ["k"], sort="asc").collect()] == ["b", "a", "c"]
    assert [r["k"] for r in A.ranked(means, ["k"], sort="desc", limit=1).collect()] == ["a"]


def test_ratio_aggregates_first_and_drops_zero_denominators(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 2.0), ("y", 1.0, 0.0)], "k string, a double, b double")
    assert as_dict(A.grouped_ratio(df, Ratio("a", "b", 100), ["k"])) == {"x": 100.0}
    assert A.scalar_ratio(df.where("k = 'y'"), Ratio("a", "b")).first()["value"] is None


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 100, list(range(1000)), [0.0, 1e9, -1e9, 3.5], [k * k * 1.7 for k in range(257)]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r["share"]: r["value"] for r in exact_quantiles(df, "v", [0.25, 0.5, 1.0]).collect()}
    assert got[0.5] == pytest.approx(statistics.median(values)) and got[1.0] == max(values)
    if len(values) > 1:
        assert got[0.25] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive")[0])


def test_quantiles_of_values_over_many_magnitudes(spark):
    values = [10 ** (18 * k / 20000) for k in range(20001)]  # most of them in the lowest of equal parts
    values += [-v for v in values[::2]] + [1e-9 * k for k in range(3000)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.1, 0.5, 0.9]).collect()
    want = {s: statistics.quantiles(values, n=10, method="inclusive")[round(10 * s) - 1] for s in (0.1, 0.5, 0.9)}
    assert {r["share"]: r["value"] for r in got} == {s: pytest.approx(v) for s, v in want.items()}


def test_filters_keep_or_drop_nulls(rows):
    count = lambda *f: apply_filters(rows, list(f)).df.count()
    assert count(Filter("k", "==", "a")) == 2 and count(Filter("k", "!=", "a")) == 4 and count(Filter("k", "not in", ["a", "b"])) == 2
    assert count(Filter("k", "in", "A")) == 2  # another case
    assert count(Filter("v", ">", "0")) == 2 and count(Filter("n", "between", [2, 4])) == 3
    skipped = apply_filters(rows, [Filter("n", ">", 100), Filter("v", ">", "many"), Filter("k", "contains", "(")])
    assert skipped.df.count() == 6 and len(skipped.warnings) == 3


def test_specs_are_repaired_and_limits_kept(rows):
    spec, notes = validate(Spec(intent="sing", metric="V", aggregation="guess", dimensions=("K", "k"), limit=500, sort="up"), rows.schema)
    assert (spec.intent, spec.metric, spec.aggregation, spec.dimensions, spec.limit, spec.sort) == ("aggregate", "v", "sum", ("k",), 500, "desc") and notes
    assert validate(Spec(intent="topn", metric="v", limit=3), rows.schema)[0].limit == 3
    with pytest.raises(ValueError, match="numeric"):
        validate(Spec(metric="k", aggregation="sum"), rows.schema)
    assert resolve("order date", ["Order-Date"]) == "Order-Date" and resolve("oder_date", ["order_date"]) == "order_date" and resolve("zzz", ["a"]) is None
    assert merge_filters(Spec(filters=(Filter("a", value=1),)), [Filter("a", value=2), Filter("b", value=3)]).filters == (Filter("a", value=1), Filter("b", value=3))
    assert Spec.from_dict(Spec(dimensions=("k",), ratio=Ratio("a", "b")).to_dict()) == Spec(dimensions=("k",), ratio=Ratio("a", "b"))
    assert run(rows, Spec(metric="v", dimensions=("k",), limit=2)).table.count() == 2


def test_periods_gaps_and_anomalies(spark):
    day = datetime.date
    df = spark.createDataFrame([(day(2017, 1, 4), 1.0), (day(2017, 3, 5), 2.0), (None, 9.0)], "d date, v double")
    labels = {g: df.where("d = date'2017-01-04'").select(S.period(F.col("d"), g)).first()[0] for g in ("day", "week", "month", "quarter", "year")}
    assert labels == {"day": "2017-01-04", "week": "2017-01-02/2017-01-08", "month": "2017-01", "quarter": "2017Q1", "year": "2017"}
    assert as_dict(S.calendar(df, "d", "v", "month"), "period") == {"2017-01": 1.0, "2017-02": 0.0, "2017-03": 2.0}
    assert [r["change"] for r in S.trend(df, "d", "month", "v").orderBy("period").collect()] == [None, 1.0]
    flat = spark.createDataFrame([(day(2017, m, 1), 100.0 if m == 7 else 1.0) for m in range(1, 13)], "d date, v double")
    assert [r["period"] for r in S.anomalies(flat, "d", "v").collect()] == ["2017-07"]
    assert S.anomalies(df, "d", "v").count() == 0 and S.anomalies(flat.withColumn("v", F.lit(1.0)), "d", "v").count() == 0


def test_constant_columns_have_no_correlation_or_one_bin(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    r = {(x["column_a"], x["column_b"]): x["r"] for x in R.correlations(df, ["a", "b", "c"]).collect()}
    assert r["a", "a"] == 1.0 and r["a", "b"] > 0.99 and r["c", "c"] is None and r["a", "c"] is None
    assert [tuple(x) for x in R.histogram(df, "c").collect()] == [(1, 5.0, 5.0, 3)]
    assert sum(x["count"] for x in R.histogram(df, "a").collect()) == 3 and R.histogram(df, "a").count() == 40
    assert R.histogram(df.limit(0), "a").count() == 0


def test_profiles(spark, rows):
    c = {r["column"]: r for r in P.counts(rows).collect()}
    assert (c["k"]["missing"], c["k"]["unique"], c["v"]["missing"], c["n"]["unique"]) == (1, 3, 2, 6)
    assert P.totals(rows.select("k", "v").unionByName(rows.select("k", "v"))).first()["duplicate_rows"] == 7
    s = {r["column"]: r for r in P.numeric_stats(rows).collect()}
    assert (s["v"]["median"], s["v"]["negatives"], s["n"]["maximum"]) == (1.0, 2, 6.0)
    names = spark.createDataFrame([(k, k % 2 == 0, k / 100, k % 3, float(k)) for k in range(50)], "row_id long, flag boolean, rate double, level int, sales double")
    roles = {r["column"]: (r["role"], r["default_aggregation"]) for r in P.roles(names).collect()}
    assert roles == {"row_id": ("identifier", None), "flag": ("dimension", None), "rate": ("metric", "mean"), "level": ("dimension", None), "sales": ("metric", "sum")}
    assert P.primary_metric(names).first()[0] == "sales"
    assert [r["column"] for r in P.rank_dimensions(names).collect()] == ["flag", "level"]
    long = "x" * 100
    assert [(r["value"], r["n"]) for r in P.top_values(spark.createDataFrame([(long,), (long,), ("y",)], "t string")).collect()] == [(long, 2), ("y", 1)]


def test_facts(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 5.0), ("b", "y", -20.0)], "g string, h string, v double")
    top = {(r["dimension"], r["rank"]): (r["label"], r["value"], r["leader_share_pct"]) for r in X.top_by_dimension(df, "v", ["g", "h"]).collect()}
    assert top["g", 1] == ("a", 15.0, -300.0) and top["h", 2] == ("y", -15.0, None)
    assert {r["dimension"]: r["label"] for r in X.negative_laggards(df, "v", ["g", "h"]).collect()} == {"g": "b", "h": "y"}
    r = X.ranking_facts(spark.createDataFrame([("a", 30.0), ("b", 20.0), ("c", 0.0)], "k string, value double"), "k").first()
    assert (r["gap_pct"], r["leader_share_pct"], r["lowest"]) == (50.0, 60.0, "c")


def test_cleaning(spark):
    assert C.tidy_names([" a \n b", "A B", "", "a b", " "]) == ["a b", "A B (1)", "unnamed", "a b (2)", "unnamed (1)"]
    texts = [("$1,234.50", 1234.5), ("(123)", -123.0), ("12%", 12.0), ("12D", None), ("NaN", None), ("-inf", None), ("1e3", 1000.0), (".5", 0.5), ("", None)]
    df = spark.createDataFrame(texts, "t string, want double").withColumn("got", C.as_number(F.col("t")))
    assert [r["got"] for r in df.collect()] == [w for _, w in texts]
    dates = [("2017-01-02", "2017-01-02"), ("1/3/2017", "2017-01-03"), ("13/02/2017", "2017-02-13"), ("Mar 4, 2017", "2017-03-04"), ("soon", None)]
    df = spark.createDataFrame(dates, "t string, want string").withColumn("got", F.date_format(C.as_date(F.col("t")), "yyyy-MM-dd"))
    assert [r["got"] for r in df.collect()] == [w for _, w in dates]
    raw = spark.createDataFrame([("0", " x ", None, "$1"), ("1", "NULL", None, "$2"), ("1", "NULL", None, "$2"), (None, None, None, None)], "`Unnamed: 0` string, `a ` string, b string, c string")
    out, report = C.clean(raw)
    assert sorted(map(tuple, out.collect()), key=str) == [(0.0, "x", 1.0), (1.0, None, 2.0)] and report.empty_columns == ["b"] and report.after["rows"] == 2


def test_delimited_sources(spark, tmp_path):
    folder = tmp_path / "messy.txt"
    folder.write_bytes('﻿id;name;price\n1;"a;b";$2,5\n2;é;N/A\n'.encode())
    df = D.read_delimited(spark, str(folder))
    assert df.columns == ["id", "name", "price"] and [tuple(r) for r in df.collect()] == [("1", "a;b", "$2,5"), ("2", "é", None)]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("id,name\n1,é\n".encode("latin-1"))
    assert D.read_delimited(spark, str(latin)).first()["name"] == "é"
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        D.read_delimited(spark, str(tmp_path / "empty.csv"))


def test_export(spark, rows):
    assert [r["n"] for r in E.page(rows, ["n"], after=[2], size=3).collect()] == [3, 4, 5]
    df = spark.createDataFrame([(1, 'a"b,c', math.nan)], "i int, s string, d double")
    assert df.select(E.csv_lines(df, ["i", "s"])).first()[0] == '1,"a""b,c"'
    assert df.select(E.json_rows(df)).first()[0] == '{"i":1,"s":"a\\"b,c","d":null}'
    assert E.fingerprint(rows).first() == E.fingerprint(rows.orderBy(F.desc("n"))).first()


def test_search(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, "")], "id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "none")], "q long, text string")
    got = V.keyword_topk(docs, asked, "id", "text", "q", "text", k=2).orderBy("rank").collect()
    want = {1: 2 / 3 * math.log(1 + 3 / 2) + 1 / 3 * math.log(1 + 3 / 3), 2: 1 / 2 * math.log(1 + 3 / 3)}
    assert [(r["query"], r["key"], r["score"]) for r in got] == [(7, k, round(want[k], 4)) for k in (1, 2)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 3.0])], "id long, v array<float>")
    got = V.vector_topk(vectors, vectors.where("id = 1"), "id", "v", "id", k=2).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [(1, 1.0), (4, 0.7071)]
    assert [(r["chunk"], r["text"]) for r in V.chunks(docs, "id", "text", size=4).where("id = 1").collect()] == [(0, "red"), (1, "red"), (2, "fox")]


def test_text_functions(spark):
    cases = [("<think>a</think> b", "b"), ("x</think>y", "y"), ("<Thinking>open", ""), ("plain", "plain")]
    assert [r[0] for r in spark.createDataFrame(cases, "t string, w string").select(strip_reasoning(F.col("t"))).collect()] == [w for _, w in cases]
    assert spark.createDataFrame([('say ```json\n{"a": {"b": 1}}\n``` ok',)], "t string").select(extract_json(F.col("t"), "a struct<b:int>")["a"]["b"]).first()[0] == 1
    shown = spark.createDataFrame([(1.5e9,), (2.5e6,), (1234.0,), (1.0,), (None,)], "v double").select(format_number(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["1.50B", "2.50M", "1,234", "1.00", "n/a"]


def test_derived_metrics_read_their_rows_twice_at_most(spark, tmp_path):
    spark.createDataFrame([(1, 5.5, 2.25, "x")] * 3, "order_id long, sales double, profit double, name string").write.parquet(str(tmp_path / "t"))
    found = P.derived_metrics(spark.read.parquet(str(tmp_path / "t")))
    assert [tuple(r) for r in found.collect()] == [("Profit Margin %", "profit", "sales", 100.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2


def test_statistics_of_metrics_alone(spark):
    rows = spark.createDataFrame([(k, k * 1.5, f"n{k}", k * 2) for k in range(20)], "order_id long, sales double, name string, `unit.price` long")
    both = {r["column"]: r for r in P.numeric_stats(rows).collect()}
    got = {r["column"]: r for r in P.metric_stats(rows).collect()}
    assert {c: r["position"] for c, r in got.items()} == {"sales": 1, "unit.price": 3}
    assert all(got[c][n] == both[c][n] for c in got for n in both[c].__fields__)
    assert P.metric_stats(rows.select("order_id", "name")) is None
