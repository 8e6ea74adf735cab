"""Folders of files, kept indexes, pages, overviews and vector blocks on small traps."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import quantiles
from quarry.operators import retrieval as V
from quarry.operators import sketches
from quarry.operators import timeseries as S
from quarry.operators.filters import CLOSE, apply_filters, candidates, evidence, snapped
from quarry.operators.overview import cells, overview
from quarry.operators.text_index import TextIndex
from quarry.plans.execute import run
from quarry.plans.spec import Filter, Ratio, Spec
from quarry.sources import export as E
from quarry.sources import folders


def test_folder_of_layouts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_bytes("﻿id;Name; a.b \n1;é;x\n2;\"y;z\";NA\n".encode())
    (tmp_path / "two.txt").write_bytes("name,A.B,ID\nlatin é,3,7\n".encode("latin-1"))
    (tmp_path / "three.tsv").write_text('id\tnote\n3\t"two\nlines"\n')
    (tmp_path / "four.csv").write_text('"id, or\nnumber"|Name\n9|n\n')
    got, judged = folders.read_folder(spark, str(tmp_path), file_column="file")
    rows = {r["file"].rsplit("/", 1)[1]: r.asDict() for r in got.collect() if r["id"] != "2"}
    assert set(got.columns) == {"id", "Name", "a.b", "note", "id, or number", "file"}
    assert (rows["one.csv"]["id"], rows["one.csv"]["Name"], rows["one.csv"]["a.b"]) == ("1", "é", "x")
    assert (rows["two.txt"]["id"], rows["two.txt"]["Name"], rows["two.txt"]["a.b"], rows["two.txt"]["note"]) == ("7", "latin é", "3", None)
    assert rows["three.tsv"]["note"] == "two\nlines" and rows["four.csv"]["id, or number"] == "9" and rows["four.csv"]["Name"] == "n"
    second = got.where("id = '2'").first()
    assert second["Name"] == "y;z" and second["a.b"] is None
    facts = {r["file"].rsplit("/", 1)[1]: (r["separator"], r["utf8"], r["over_lines"], r["lines"], r["problem"]) for r in judged.collect()}
    assert facts == {"one.csv": (";", True, False, 3, None), "two.txt": (",", False, False, 2, None), "three.tsv": ("\t", True, True, 3, None), "four.csv": ("|", True, True, 3, None)}
    assert folders.layouts(judged).count() == 4


def test_files_without_rows_are_named(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "no bytes.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n\n  \n")
    with pytest.raises(ValueError, match=r"header.csv: no rows; .*no bytes.csv: no bytes"):
        folders.read_folder(spark, str(tmp_path))
    rows, judged = folders.read_folder(spark, str(tmp_path), on_problem="skip")
    assert [tuple(r) for r in rows.collect()] == [("1", "2")] and judged.where("problem is not null").count() == 2
    (tmp_path / "good.csv").unlink()
    with pytest.raises(ValueError, match="has no rows"):
        folders.read_folder(spark, str(tmp_path), on_problem="skip")


def test_separators_in_latin_lines(spark, tmp_path):
    # A byte like 0xE9 begins a longer character in UTF-8; the separators after it still count.
    (tmp_path / "l.csv").write_bytes(b"a;b;c\n" + b"\xe9;\xe9;\xe9\n" * 5)
    got, judged = folders.read_folder(spark, str(tmp_path))
    assert judged.first()["separator"] == ";" and [tuple(r) for r in got.distinct().collect()] == [("é", "é", "é")]


def texts(seed, n):
    r = random.Random(seed)
    return [(k, " ".join(r.choices([f"t{j}" for j in range(40)], weights=[1 / (j + 1) for j in range(40)], k=r.randrange(0, 300))), r.choice("xyz")) for k in range(n)]


def test_index_of_batches_is_that_of_all_texts(spark, tmp_path):
    rows = texts(1, 300)
    frame = lambda r: spark.createDataFrame(r, "id long, text string, source string")
    index = TextIndex(spark, str(tmp_path / "i"), key="id", block_documents=16)
    assert index.batches() == [] and index.size().first() == (0, 0) and index.search(frame(rows[:2]), "id", "text")[0].count() == 0
    index.add(frame([(k, t + " old", s) for k, t, s in rows[:200]] + [(999, "t0 gone", "w"), (None, "t0", "x")]), "text", "source")
    index.add(frame(rows[150:]), "text", "source")
    assert index.add(frame(rows[:10]), "text", "source") == 2  # all are known
    index.replace(frame(rows[:200]), "text", "source", by_label=True)
    index.replace(frame([r for r in rows[200:]]), "text", "source")
    index.remove(frame([(999, "", "")]).select("id"))
    whole = TextIndex(spark, str(tmp_path / "w"), key="id", block_documents=16)
    whole.add(frame(rows), "text", "source")
    plain = lambda df: sorted(map(tuple, df.collect()))
    small = index.compact(str(tmp_path / "c"))
    for other in (index, small):
        assert plain(other.postings()) == plain(whole.postings()) and plain(other.frequencies()) == plain(whole.frequencies())
        assert other.size().first() == whole.size().first() and plain(other.documents()) == plain(whole.documents())
    want = plain(V.term_index(frame(rows), "id", "text").select("id", "token", "tf", F.col("length").cast("long")))
    assert plain(whole.postings().select("key", "token", "tf", "length")) == want
    asked = frame([(1, "t0 t39 t38 t38", ""), (2, "t5 none", ""), (3, "none", "")])
    best = plain(V.keyword_topk(frame(rows), asked, "id", "text", "id", "text", k=7))
    for other in (index, whole, small):
        got, about = other.search(asked, "id", "text", k=7)
        assert plain(got) == best
    read, every = about.read.count(), about.all.count()
    assert every == sum((" " + t + " ").count(" t") > 0 and sum(f" {w} " in f" {t} " for w in q) for _, t, _ in rows for q in (("t0", "t39", "t38"), ("t5",)))
    assert read < 0.8 * every
    with pytest.raises(ValueError, match="more than once"):
        index.add(frame([(5000, "a", ""), (5000, "b", "")]), "text")


def test_pages_hold_every_row_once(spark):
    rows = [(None, "a")] * 5 + [(1, "a")] * 7 + [(1, None)] * 3 + [(k, str(k)) for k in range(2, 9)]
    df = spark.createDataFrame(rows, "k long, `t.x` string")
    for size in (1, 4, 5, 22, 50):
        got = list(E.pages(df, ["k"], size))
        assert sorted((tuple(r) for p in got for r in p.rows), key=str) == sorted(rows, key=str)
        assert {p.total for p in got} == {22} and all(len(p.rows) == size for p in got[:-1]) and got[0].columns == [("k", "number"), ("t.x", "text")]
        keys = [r["k"] for p in got for r in p.rows]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [tuple(r) for r in E.page(df, ["k"], after=[None], size=1).collect()][0][0] == 1
    none = E.read_page(df.limit(0), ["k"])
    assert none.rows == [] and none.total == 0 and none.after is None


def test_quantiles_take_any_names(spark):
    rows = [(a, b, float(v)) for a, b in ((1, "x"), (2, "y")) for v in range(10)] + [(3, "z", None), (None, "x", 5.0)]
    df = spark.createDataFrame(rows, "rank long, `v.n` string, `a.value` double")
    got = {(r["rank"], r["v.n"]): (r["low"], r["total"]) for r in quantiles.quantile_columns(df, "a.value", {"low": 0.1, "total": 0.5}, ["rank", "v.n"]).collect()}
    assert got == {(1, "x"): (pytest.approx(0.9), 4.5), (2, "y"): (pytest.approx(0.9), 4.5), (None, "x"): (5.0, 5.0)}
    assert quantiles.quantile_columns(df.limit(0), "a.value", {"m": 0.5}).first() == (None,)
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df.withColumnRenamed("rank", "share"), "a.value", [0.5], ["share"])


def test_quantiles_of_one_group_over_many_partitions(spark):
    r = random.Random(4)
    values = [10 ** r.uniform(-9, 9) * r.choice((-1, 1)) for _ in range(3000)] + [1.5] * 2000
    got = quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 0.1, 0.25, 0.5, 0.9, 1]).orderBy("share").collect()
    assert [x["value"] for x in got] == pytest.approx([float(np.quantile(values, s)) for s in (0, 0.1, 0.25, 0.5, 0.9, 1)])


def test_the_source_of_quantiles_is_read_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 as k", "cast(id as double) as v").write.parquet(str(tmp_path / "t"))
    plan = quantiles.quantile_columns(spark.read.parquet(str(tmp_path / "t")), "v", {"m": 0.5}, ["k"])
    assert str(tmp_path / "t") not in plan._jdf.queryExecution().executedPlan().toString()


def test_long_numbers_are_compared_exactly(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1.5), (big - 1, 2.5), (7, 3.5)], "id long, x double")
    left = lambda *f: sorted(r["id"] for r in apply_filters(df, list(f), snap=False).df.collect())
    assert left(Filter("id", "==", big)) == [big] and left(Filter("id", "==", str(big))) == [big] and left(Filter("id", "in", [big, "7.0"])) == [7, big]
    assert left(Filter("id", "!=", big)) == [7, big - 1] and left(Filter("id", ">", big - 1)) == [big] and left(Filter("id", "between", [str(big), 1e19])) == [big]
    assert left(Filter("id", "<", "7.5")) == [7] and left(Filter("x", ">=", "2.5")) == [7, big - 1] and left(Filter("x", "in", [1, 1.5])) == [big]
    assert left(Filter("id", "<", "1e60")) == [7, big - 1, big] and left(Filter("id", "<", float("inf"))) == [7, big - 1, big]
    assert apply_filters(df, [Filter("id", "==", "x")], snap=False).warnings
    exact = spark.createDataFrame([("12345678901234567.89",), ("12345678901234567.88",)], "t string").select(F.col("t").cast("decimal(30,2)").alias("d"))
    assert apply_filters(exact, [Filter("d", "==", "12345678901234567.89")]).df.count() == 1


def test_specs_of_texts_and_dates(spark):
    df = spark.createDataFrame([("a", 1, "2020-01-05"), ("b", 2, "2020-02-01"), ("a", 3, "2020-01-01")], "t string, n long, d string").withColumn("d", F.to_timestamp("d"))
    assert [tuple(r) for r in run(df, Spec(intent="distribution", metric="t")).table.collect()] == [("a", 2), ("b", 1)]
    assert [r["n"] for r in run(df, Spec(intent="rows", metric="d", sort="asc", limit=2), keys=("n",)).table.collect()] == [3, 1]
    assert [r["t"] for r in run(df, Spec(intent="rows", metric="t", sort="desc"), keys=("n",)).table.collect()] == ["b", "a", "a"]
    assert run(df, Spec(intent="describe", metric="t")).table.count() == 3
    with pytest.raises(ValueError, match="one is missing"):
        run(df, Spec(intent="relationship", metric="n"))
    with pytest.raises(ValueError, match="t is string"):
        run(df, Spec(intent="relationship", metric="n", second_metric="t"))
    with pytest.raises(ValueError, match="sum needs"):
        run(df, Spec(metric="t"))
    named = df.withColumnRenamed("t", "period")
    got = S.trend(named, "d", "month", "n", by=["period"])
    assert got.columns == ["period 2", "period", "value"] and sorted(map(tuple, got.collect())) == [("2020-01", "a", 4.0), ("2020-02", "b", 2.0)]


def test_evidence_names_filters_and_columns(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 9)], "t string, n long")
    got = evidence(df, [Filter("t", "in", ["a"]), Filter("n", "between", [0, 5])], used=["n"]).first()
    assert (got["rows_in_dataset"], got["rows_after_filters"], got["filters"], got["columns_used"]) == (3, 1, ["t in a", "n between 0 and 5"], ["n", "t"])
    assert evidence(df, []).first()["filters"] == ["none"]


def test_categories_that_may_be_close(spark):
    import difflib

    r = random.Random(2)
    names = ["".join(r.choices("abcde ", k=r.randrange(1, 9))) for _ in range(400)] + ["Widget", "widgets", "wIdgit", "widgte"]
    df = spark.createDataFrame([(n,) for n in names], "value string")
    for wanted in ("widget", "abcd e", "a"):
        passed = {x["value"] for x in candidates(df, [wanted]).collect()}
        close = {n for n in names if difflib.SequenceMatcher(None, wanted, n.lower()).ratio() >= CLOSE}
        assert close <= passed and len(passed) < len(set(names)) / 4
    assert snapped(df, [Filter("value", "==", "WIDGET"), Filter("value", "in", ["widgts", "nothing like"])]) == [Filter("value", "==", "Widget"), Filter("value", "in", ["widgets", "nothing like"])]


def test_dates_are_read_in_the_columns_style(spark):
    rows = [("03/04/2020", "03/04/2020", "a"), ("13/02/2020", "12/25/2020", "b"), ("01/01/2021", "1/2/2021", "c")]
    out, report = C.clean(spark.createDataFrame(rows, "`day one` string, `day two` string, k string"))
    got = {r["k"]: (r["day one"].strftime("%m-%d"), r["day two"].strftime("%m-%d")) for r in out.collect()}
    assert got == {"a": ("04-03", "03-04"), "b": ("02-13", "12-25"), "c": ("01-01", "01-02")}
    assert report.dates == ["day one", "day two"] and report.day_first == ["day one"] and report.after["missing"] == 0


def test_overview_reads_its_view_once(spark, tmp_path):
    rows = [("2020-01-03", "a", 1.0, 4.0), ("2020-03-03", "b", 3.0, 2.0), ("2020-03-05", None, None, 1.0), (None, "a", 2.0, None)]
    spark.createDataFrame(rows, "d string, k string, m double, c double").withColumn("d", F.to_timestamp("d")).write.parquet(str(tmp_path / "v"))
    view = spark.read.parquet(str(tmp_path / "v"))
    assert cells(view, "m", "d", ["k"])._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out = overview(view, {"m": "sum", "c": "mean"}, [("x", Ratio("m", "c", 100))], date="d", dimensions=["k"], bins=2)
    assert str(tmp_path / "v") not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["kind"], r["key"]): r["value"] for r in out.collect()}
    assert got == {
        ("card", "Rows"): 4, ("card", "Total m"): 6, ("card", "Avg c"): pytest.approx(7 / 3), ("card", "x"): pytest.approx(600 / 7), ("card", "Distinct k"): 2, ("month", "2020-01"): 1, ("month", "2020-02"): 0, ("month", "2020-03"): 3,
        ("top", "k|1|a"): 3, ("top", "k|2|b"): 3, ("bin", "1"): 1, ("bin", "2"): 2, ("correlation", "m|c"): -1, ("missing", "d"): 25, ("missing", "k"): 25, ("missing", "m"): 25, ("missing", "c"): 25,
    }
    assert overview(view.limit(0), {"m": "sum"}, date="d", dimensions=["k"]).where("kind = 'card'").count() == 2


def test_sketches_of_batches_are_those_of_the_whole(spark, tmp_path):
    r = random.Random(11)
    rows = [(r.randrange(4000), r.gauss(0, 1) if r.random() < 0.9 else None, r.choice("abcde") * 3, "long " * 30 + str(k % 3)) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, `v.x` double, t string, l string")
    store = sketches.ProfileStore(spark, str(tmp_path / "s"))
    store.add(df.where("id % 2 = 0"))
    store.add(df.where("id % 2 = 1"))
    store.add(df.limit(0))
    halves, whole = store.merged(), sketches.sketches(df)
    got, one = ({x["column"]: x for x in sketches.profile(h).collect()} for h in (halves, whole))
    for c, k in (("id", 0), ("v.x", 1), ("t", 2), ("l", 3)):
        values = [x[k] for x in rows if x[k] is not None]
        for p in (got, one):
            assert (p[c]["rows"], p[c]["missing"]) == (6000, 6000 - len(values))
            assert abs(p[c]["distinct_about"] - len(set(values))) <= sketches.DISTINCT_ERROR * len(set(values)) + 0.5
            if k < 2:
                for s in (25, 50, 75):
                    assert abs(sum(v <= p[c][f"p{s}_about"] for v in values) / len(values) - s / 100) <= sketches.RANK_ERROR + 1 / len(values)
            else:
                assert p[c]["p50_about"] is None
    top = [(x["value"], x["n"]) for x in sketches.top_values(halves).where("column = 't'").orderBy("rank").collect()]
    counts = {v: sum(x[2] == v for x in rows) for v in {x[2] for x in rows}}
    assert top == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert sketches.profile(sketches.sketches(df.limit(0))).first()["distinct_about"] == 0


def test_vector_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(f"k{k:03}", [float(x) for x in r.integers(-3, 4, 3)]) for k in range(200)] + [("none", None), ("nan", [1.0, math.nan, 0.0]), ("hole", [1.0, None, 0.0]), ("short", [1.0]), ("zero", [0.0] * 3)]
    df = spark.createDataFrame(rows, "key string, v array<double>")
    asked = df.where("key < 'k010' or key in ('zero', 'none', 'short')")
    monkeypatch.setattr(V, "GROUP", 4)
    got = sorted((x["query"], x["rank"], x["key"], x["score"]) for x in V.vector_topk(df, asked, "key", "v", "key", k=6, blocks=5).collect())
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and None not in v and np.linalg.norm(v) > 0}
    want = []
    for q in (k for k, _ in rows if (k < "k010" or k == "short") and k in unit):
        scored = sorted((-math.floor(max(0.0, float(unit[q] @ u)) * 10_000 + 0.5) / 10_000, k) for k, u in unit.items() if len(u) == len(unit[q]))
        want += [(q, n, k, -s) for n, (s, k) in enumerate(scored[:6], 1)]
    assert [(q, n, s) for q, n, _, s in got] == [(q, n, pytest.approx(s)) for q, n, _, s in sorted(want)]
    assert [(q, k) for q, _, k, _ in got] == [(q, k) for q, _, k, _ in sorted(want)]
    assert V.vector_topk(df.limit(0), asked, "key", "v", "key").count() == 0 and V.vector_topk(df, asked.limit(0), "key", "v", "key").count() == 0


def test_batches_that_are_taken_out_whole_are_not_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    docs = lambda *rows: spark.createDataFrame(rows, "key long, text string")
    index.add(docs((1, "a b"), (2, "b b"), (3, None)), "text")
    index.replace(docs((1, "c"), (2, "b C"), (3, "d")), "text")
    assert {f.split("/postings/")[1].split("/")[0] for f in index.postings().inputFiles()} == {"batch-1"}
    assert {tuple(r) for r in index.frequencies().collect()} == {("c", 2), ("b", 1), ("d", 1)}
    index.remove(docs((2, "")).select("key"))
    assert {tuple(r) for r in index.postings().collect()} == {(1, "c", 1, 1), (3, "d", 1, 1)}
    assert {tuple(r) for r in index.frequencies().collect()} == {("c", 1), ("d", 1)}
    assert tuple(index.size().first()) == (2, 2)


def test_keyword_scores_with_repeated_keys_and_small_batches(spark, monkeypatch):
    random.seed(4)
    words = ["a", "b", "c", "d", "e", "f"]
    docs = [(random.choice([None, *range(12)]), " ".join(random.choices(words, k=random.randint(0, 6)))) for _ in range(60)] + [(99, None)]
    asked = [(q, " ".join(random.choices([*words, "z"], k=3))) for q in [None, *range(5)]]
    monkeypatch.setattr(V, "GROUP", 2)
    monkeypatch.setattr(V.Asked, "CELLS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        frames = [spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(asked, "q long, t string")]
        got = [tuple(r) for r in V.keyword_topk(*frames, "d", "t", "q", "t", k=4).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tf = {}
    for key, text in docs:
        own = (text or "").split()
        for w in own:
            tf[key, w, len(own)] = tf.get((key, w, len(own)), 0) + 1
    df = {w: sum(x[1] == w for x in tf) for w in words}
    want = []
    for q, text in asked:
        scores = {}
        for (key, w, length), n in tf.items():
            if text.split().count(w):
                scores[key] = scores.get(key, 0.0) + n / length * text.split().count(w) * math.log(1 + len(docs) / (1 + df[w]))
        ranked = sorted(((-round(x, 4), key is not None, key or 0, key) for key, x in scores.items()))[:4]
        want += [(q, k, r[3], -r[0]) for k, r in enumerate(ranked, 1)]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[:3] for r in order(got)] == [r[:3] for r in order(want)]
    assert all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(order(got), order(want), strict=True))
