"""The text operators against brute force and the libraries, and on nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import struct
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, fingerprint, html_extract, lang_id, near_dedup, packing, secret_scan, token_counts, toxicity, url_filter
from quarry.llm.common import WordHashes, fold_of, shingle_hashes, word_bytes

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces ", "tab\tand\nline", "é à ü ß ñ 日本語 😀", "▁x ▁", "<s> </s> <|endoftext|>", "It's I'LL 1234.5, U.S.", "x" * 3000, "word " * 6000, "\x00\x1c\x85", "x². a_.b", "ΣΑΣ İstanbul", "ﬁ ①"]
SCHEMA = "doc_id long, text string, n_tokens string, score string, `Row` string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, two repeated rows, a null id, and columns named like results."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "\n\n"), (3, "\n\n"), (None, "no id")]
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_token_counts_are_the_librarys(odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(odd, PIECES, limit=100).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        n = len(library.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100), r["text"]
    assert token_counts.count_tokens(odd, PIECES).count() == odd.count() and token_counts.count_tokens(empty, PIECES).count() == 0


def test_merging_takes_the_lowest_rank_first():
    # Symbols a=10 b=11 c=12; "bc" (0) goes before "ab" (1), then "a"+"bc" (2).
    pairs = {11 << 8 | 12: 0, 10 << 8 | 11: 1, 10 << 8 | 0: 2}
    ids = [10, 11, 12, 10, 11]
    assert token_counts.merge(ids, pairs, 8) == 3 and [i for i in ids if i >= 0] == [2, 1]


BASE = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
SECRETS = ["token=secret=abcdefgh12", 'API_KEY : "abcdefgh" and password="short" passwd=longenough1', "token:secret:abcdefgh", "AKIA" + "A" * 12 + " AKIAB" + " 😀é secret=0123456789abcdef0123456789abcdef0123", "deadbeef" * 4 + "x" + "0" * 31, "to" + "ken" + " " * 50 + "= aaaaaaaa", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]


def test_secret_spans_are_those_of_plain_scans(spark, odd, empty):
    texts = ODD + SECRETS + ["x " * 20000 + "password=hunter2hunter2"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in secret_scan.secret_report(docs).collect():
        text = texts[r["doc_id"]] or ""
        found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least]
        joined = ",".join(s for *_, s in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text[:80]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert {s for *_, s in found} <= set(r["spans"].split(",")) | {""}
    assert secret_scan.secret_report(odd).count() == odd.count() and secret_scan.secret_report(empty).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{12,}") == [{"aki", "kia"}]
    assert secret_scan.trigram_query("(abc|xyzw)d*") == [{"abc"}, {"xyz", "yzw"}]
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is None and secret_scan.trigram_query("(abc)?de") is None
    assert secret_scan.trigram_query("api_?key") == [{"_ke", "api", "i_k", "key", "pi_"}, {"api", "ike", "key", "pik"}]


def test_redaction_masks_overlapping_spans_once(spark):
    docs = spark.createDataFrame([(1, "é token=" + "ab12" * 10 + " end " + "f" * 40), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["row"]["text"] for r in secret_scan.redact(secret_scan.find_secrets(docs)).collect()}
    assert got == {1: "é [SECRET] end [SECRET]", 2: "clean", 3: None}


def toxic_rows(n: int):
    rows = []
    for k in range(n):
        words = prose(k, 30 + k % 90)
        if k % 3 == 0:
            words[k % len(words)] = ("zorkish", "zorkable")[k % 2]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    return rows


def test_toxicity_learns_and_scores_whole_texts(spark, odd, empty):
    rows = toxic_rows(240)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    network = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    late = " ".join(prose(999, 5000) + ["zorkest"] + prose(998, 40))  # far into a long text, with an ending not learned
    tested = spark.createDataFrame([(1, late), (2, " ".join(prose(997, 5000))), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(tested, network).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[3]["score"] == got[4]["score"] < 0.5
    assert toxicity.score(odd, network).count() == odd.count() and toxicity.score(empty, network).count() == 0
    assert toxicity.learn(docs, docs.select("doc_id", "toxic").where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(tested, None).collect()} == {0.0}


def test_toxicity_sample_is_bounded(spark):
    long = "y" * 5000
    rows = [(1, "same"), *[(1, f"own {k}") for k in range(50)], *[(1, "same")] * 50, (2, long), (3, "short"), (4, "clean"), (4, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    whole = toxicity.sample(docs, labels, 2000, 10**6)
    assert whole == sorted([("same", 1), *[(f"own {k}", 1) for k in range(50)], (long, 0), ("short", 0), ("clean", 0)])  # equal rows once
    assert sum(y for _, y in toxicity.sample(docs, labels, 20, 10**6)) == 20
    assert [t for t, y in toxicity.sample(docs, labels, 2000, 100) if not y] == ["clean"]  # whole texts, up to the first that doesn't fit, so that short ones aren't preferred
    assert [t for t, y in toxicity.sample(docs, labels.where("doc_id in (1, 2)"), 2000, 100) if not y] == [long]


def test_training_holds_no_wide_tables():
    """The driver trains: its Python holds counts in 16 bits for each fold (40 MB), not whole tables of wider numbers beside them."""
    texts, labels = zip(*((t, y) for _, t, y in toxic_rows(24)), strict=True)
    tracemalloc.start()
    try:
        network = toxicity.train(list(texts), np.array(labels), epochs=1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80e6
    plain = np.zeros((2, 1 << toxicity.EVIDENCE_BITS), np.int64)
    for text, y in [*zip(texts, labels, strict=True), ("", 0)]:
        if text:
            plain[y, np.unique(toxicity._evidence_bucket(toxicity.features(list(dict.fromkeys(toxicity.words_of(text.lower()))))[0]))] += 1
    assert (network.evidence[0] == toxicity._evidence(plain[1], plain[0], sum(labels), len(labels) + 1 - sum(labels))).all()


def test_toxicity_of_repeated_labels_and_texts(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 0), (1, 0), (2, None), (3, 2), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, 100, 10**6) == [("text 0", 1), ("text 1", 0)]
    rows = toxic_rows(90)
    network = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]), epochs=1)
    again = spark.createDataFrame([(k, t) for k in range(3) for _, t, _ in rows[:20]] + [(5, None), (6, "")], "doc_id long, text string")
    scores = {}
    for r in toxicity.score(again, network, more={"t": F.coalesce("text", F.lit(""))}).collect():
        scores.setdefault(r["t"], set()).add(round(r["score"], 6))
    assert all(len(s) == 1 for s in scores.values())
    left = toxicity.without_toxic(again, network, threshold=2.0).collect()
    assert len(left) == again.count() and toxicity.without_toxic(again, None).count() == again.count() and toxicity.without_toxic(again.limit(0), network).count() == 0


def test_toxicity_gradients_are_right():
    network, r = toxicity.Network(3), np.random.default_rng(0)
    network.w = {k: x.astype(np.float64) for k, x in network.w.items()}
    vectors, index, target = r.standard_normal((20, toxicity.INPUT)), r.integers(0, 20, (4, 7)), np.array([1, 0, 1, 0.0])
    index[1, 5:] = index[2, 3:] = -1

    def loss():
        states, _ = network.run(network.inputs(vectors), index)
        p = 1 / (1 + np.exp(-(network.pool(states, index)[2] @ network.w["out"] + network.w["bias"])))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    g, _ = network.gradients(vectors, index, target)
    for name, slope in g.items():
        at, step = tuple(r.integers(0, n) for n in network.w[name].shape), 1e-2
        kept = network.w[name][at]
        network.w[name][at] = kept + step
        above = loss()
        network.w[name][at] = kept - step
        below = loss()
        network.w[name][at] = kept
        assert (above - below) / (2 * step) == pytest.approx(float(slope[at]), rel=0.02, abs=2e-5)


def test_windows_cover_the_text():
    for n in (0, 1, 47, 48, 49, 88, 89, 1000):
        spans = toxicity.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] < a[1] for a, b in itertools.pairwise(spans))


def near_rows():
    rows, base = [], prose(1, 60, 5000)
    rows.append(" ".join(base))
    for k in range(40):  # one large group whose members are linked through others
        words = list(base)
        for at in range(k % 3 + 1):
            words[(7 * k + 13 * at) % 60] = f"new{k}-{at}"
        rows.append(" ".join(words))
    chain = prose(2, 80, 5000)
    for k in range(12):  # each like its neighbours alone
        chain = chain[3:] + [f"chain{k}-{i}" for i in range(3)]
        rows.append(" ".join(chain))
    rows += [" ".join(prose(50 + k, 30, 5000)) for k in range(40)] + ["Same Text Here"] * 20 + ["same\ttext  here", "", None, "one", "one", " \n"]
    return [(1000 - k, t) for k, t in enumerate(rows)]


def brute_components(rows):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_groups_are_those_of_all_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in rows], "doc_id long, text string, n int, label string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs).collect()}
    assert got == brute_components(rows)


def test_one_document_of_each_group_stays(spark, odd, empty):
    docs = spark.createDataFrame([(3, "a b c", "l"), (1, "a b c", "m"), (2, "d e f", None), (2, "d e f", None), (None, "a b c", "x"), (None, "a b c", "x"), (7, None, "x"), (8, "", "x")], "doc_id long, text string, lang string")
    kept = near_dedup.one_of_each(docs).collect()
    assert sorted((str(r["doc_id"]), r["lang"] or "") for r in kept) == [("1", "m"), ("2", ""), ("7", "x"), ("8", "x"), ("None", "x"), ("None", "x")]
    assert near_dedup.near_groups(odd).count() == odd.count() and near_dedup.near_groups(empty).count() == 0


def test_an_id_on_different_texts(spark):
    copied, own, one, other = (" ".join(prose(70 + k, 30, 10**6)) for k in range(4))
    rows = [(3, copied), (5, copied), (5, own), (9, one), (9, other), (9, other), (2, other), (None, own)]
    docs = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 2, False), (2, 2, True), (None, None, True)}  # one document links by any text
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns  # a row goes by its own text
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, copied), (5, own), (9, one), (2, other), (None, own)], key=str)


def test_texts_move_with_classes_not_with_pairs(spark, monkeypatch):
    """Small groups of texts that look alike without a link: each text meets those of its group in few places, not each of them in a place of its own."""
    rows, key = [], 0
    for group in range(8):
        base = prose(900 + group, 120, 10**6)
        for k in range(9):
            words = list(base)
            for at in (12 * k + 5, 12 * k + 11):  # two words of its own: 0.7 of the shingles of any two are the same
                words[at] = f"own{group}-{k}-{at}"
            rows, key = [*rows, (key, " ".join(words))], key + 1
    monkeypatch.setattr(near_dedup, "HELD", 8)
    moved, meet = [], near_dedup._meet

    def counted(members, *more):
        moved.append(members.where("hubs is not null").groupBy("id").agg(F.count("*").alias("rows"), F.sum(F.size("hubs")).alias("hubs")).collect())
        return meet(members, *more)

    monkeypatch.setattr(near_dedup, "_meet", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    last = moved[-1]
    assert sum(r["hubs"] for r in last) > 4 * len(last) and sum(r["rows"] for r in last) < 2 * len(last)


def test_hubs_are_similar_as_one_by_one(monkeypatch):
    r = np.random.default_rng(4)
    pool = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    some = lambda: pool[r.random(len(pool)) < r.choice([0.0, 0.02, 0.5, 0.85, 0.95])]
    for asked, percent in ((1, 75), (8, 75), (8, 50), (1000, 75)):
        monkeypatch.setattr(near_dedup, "ASKED", asked)
        sets, hubs = near_dedup.HubSets(percent), {}
        for k in range(60):  # ten hubs with two sets
            hubs.setdefault(k % 50, []).append(some())
            sets.add(k % 50, hubs[k % 50][-1])
        for _ in range(40):
            own, wanted = some(), r.choice(60, r.integers(1, 40), replace=False).tolist()
            assert sets.similar_to(own, wanted) == [v for v in wanted if any(near_dedup.similar(own, x, percent) for x in hubs.get(v, []))]
    nothing = near_dedup.HubSets(75)
    nothing.add(1, np.empty(0, np.uint64))
    assert nothing.similar_to(pool, [1] * 20) == [] and nothing.similar_to(np.empty(0, np.uint64), list(range(20))) == []


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    texts = [*ODD, " ".join(prose(1, 4)), " ".join(prose(2, 5)), " ".join(prose(3, 6)), "same " * 50, *(" ".join(prose(k, 90, 40)) for k in range(30)), "\ud800 lone surrogate of five words"]
    for together in (1, 100, 30_000):
        monkeypatch.setattr(common, "WORDS_TOGETHER", together)
        for size in (1, 3, 5):
            got = common.shingle_sets(texts, size)
            assert len(got) == len(texts) and all((a == shingle_hashes(word_bytes(t), WordHashes(), size)).all() and len(a) == len(shingle_hashes(word_bytes(t), WordHashes(), size)) for a, t in zip(got, texts, strict=True))
    assert common.shingle_sets([]) == []


def test_points_drawn_together_are_those_drawn_one_by_one(monkeypatch):
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 700, 1, 3000)]
    want = None
    for points, most in ((1, 1), (100, 7), (8192, 64), (10**6, 1000)):
        monkeypatch.setattr(near_dedup, "POINTS", points)
        monkeypatch.setattr(near_dedup, "MOST_POINTS", most)
        got = near_dedup.sketches(sets)
        assert want is None or (got == want).all()
        want = got


def test_sketches_merge_and_estimate():
    hashes = WordHashes()
    a, b = (shingle_hashes([w.encode() for w in x], hashes) for x in (prose(1, 900, 10**6), prose(1, 900, 10**6)[:800] + prose(2, 100, 10**6)))
    both = np.union1d(a, b)
    one, other, union = near_dedup.sketches([a, b, both])
    assert (np.maximum(one, other) == union).all()
    true = len(np.intersect1d(a, b)) / len(both)
    guess = near_dedup.estimate(one[None], other[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(guess - true) < 0.12


PAGE = """<html><head><title>Not this</title><style>p{}</style></head><body><nav><a href="/">Menu</a></nav><div class="cookie-notice">We use cookies, agree.</div>
<header>Site header.</header><!-- <p>hidden</p> --><article><h1>Heading &amp; more</h1><p>First <b>bold</b>&nbsp;text,\n with   space.<br>Next line.<p>Second one&hellip; 3 &lt; 4.</p><script>var x = "</p>";</script>
<ul><li>A point, too.</li></ul><form><p>Subscribe now, please.</p></form><aside>Related stories here.</aside><div class="comments"><p>I disagree, strongly!</p></div></article><div id="sidebar"><p>Other news, today.</p></div><footer>&copy; us, 2024.</footer></body></html>"""


def test_main_text(spark):
    want = "Heading & more\n\nFirst bold text, with space. Next line.\n\nSecond one… 3 < 4.\n\nA point, too."
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text(PAGE.replace("article>", "div>")) == want  # unmarked, told by its paths alone
    assert html_extract.main_text(PAGE[: PAGE.index("<form>")]) == want  # cut off
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", PAGE, "x"), (3, "u", "<p>" * 2000 + "deep.", "x"), (4, "u", "<nav>x</nav>", "x"), (3, "u", "no markup at all.", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_text(pages).collect()
    assert sorted(r["text"] for r in got) == sorted(["", "", want, "deep.", "", "no markup at all."]) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_names_leave_out_no_article_text():
    text = "Some words of the text, and more of them, as they come."
    for name in ("content has-sidebar", "layout-sidebar-left", "no-comments with-footer", "page search"):
        assert html_extract.main_text(f'<body><div class="{name}"><article><p>{text}</p></article></div></body>') == text
    inside = f'<h2 id="related-work">Work</h2><section id="search-methods"><p>{text}</p></section><div class="post-header"><h1>Title</h1></div><p data-ad-id="7" data-x-class="ad" title="an id=ad">{text}</p>'
    assert html_extract.main_text(f"<article>{inside}</article>") == f"Work\n\n{text}\n\nTitle\n\n{text}"
    # What is marked and has neither still goes, and so do teasers beside the article.
    noise = "".join(f'<div {x}><p>{text}</p></div>' for x in ('class="cookie-notice"', 'id="comments"', 'id="left-sidebar"', "class=ad", 'role="search"'))
    teaser = '<div class="related"><article><h3>Teaser</h3><p>Read on.</p></article></div>'
    assert html_extract.main_text(f"<body><article><p>{text}</p>{noise}</article>{teaser}</body>") == text
    assert html_extract.main_text(f'<body><div class="content"><p>{text}</p></div>{teaser}</body>') == text


def test_links_and_short_items_of_an_article_stay():
    text = "Some words of the text, and more of them, as they come. "
    refs = "".join(f'<li><a href="/{k}">Reference {k}</a></li>' for k in range(8))
    got = html_extract.main_text(f'<article><h1><a href="/">Title</a></h1><p>{text * 40}</p><ul>{refs}</ul></article>')
    assert got.split("\n\n") == ["Title", (text * 40).strip(), *(f"Reference {k}" for k in range(8))]
    paragraph = ("some words without marks and more of them " * 50)[:1970] + "." * 30
    for n in (10, 300):
        items = [f"an item of twenty {k:03}" for k in range(n)]
        parts = [f"<p>{paragraph}</p>"] * 5 + ["<ul>", *(f"<li>{x}</li>" for x in items), "</ul>"] + [f"<p>{paragraph}</p>"] * 5
        page = f'<body><div><div><a href="/">Home</a></div></div><div>{"".join(parts)}</div><div><div><a href="/i">Imprint</a></div></div></body>'
        assert html_extract.main_text(page).split("\n\n") == [*[paragraph] * 5, *items, *[paragraph] * 5]


def test_components_of_any_graph(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_NODES", 30)
    r = random.Random(3)
    path = r.sample(range(1000, 3000), 150)
    edges = list(zip(path, path[1:])) + [(5000, k) for k in range(5001, 5100)] + [(r.randrange(900), r.randrange(900)) for _ in range(300)] + [(7, 7)]
    own = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(own[a], own[b])
            changed = changed or (own[a], own[b]) != (low, low)
            own[a] = own[b] = low
    frame = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {(x["node"], x["label"]) for x in near_dedup.components(frame).collect()}
    assert got == {(x, y) for x, y in own.items() if list(own.values()).count(y) > 1}
    assert near_dedup.components(frame.limit(0)).count() == 0


def test_edges_are_found_once_by_all_tasks(spark):
    tasks = spark.sparkContext.accumulator(0)

    def found(batches):
        tasks.add(1)
        yield from batches

    edges = spark.range(0, 40, 1, 7).selectExpr("id u", "id + 1 v").mapInArrow(found, "u long, v long")
    assert {x["label"] for x in near_dedup.components(edges).collect()} == {0} and tasks.value == 7
    written = common.checkpointed(edges)
    for n in (40, 10**7):
        assert {(x["node"], x["label"]) for x in near_dedup.components(written, n).collect()} == {(k, 0) for k in range(41)}


def test_members_meet_what_shares_a_bucket():
    r = np.random.default_rng(6)
    registers = r.integers(0, 4, (60, near_dedup.REGISTERS)).astype(np.uint16)
    registers[20:40] = registers[:20]
    registers[20:40, ::9] = 9
    bands = np.ascontiguousarray(registers).view(np.int64)
    names, labels, sizes = np.arange(60) + 100, np.arange(60) % 7, r.integers(60, 100, 60)
    held = near_dedup.Held(names[:35], labels[:35], sizes[:35], bands[:35], percent=55)
    got = [p for some in held.meet(names, labels, sizes, bands) for p in some]
    least = near_dedup._least_equal(55)
    want = {(int(names[i]), int(names[j])) for i in range(60) for j in range(35) if labels[i] != labels[j] and (bands[i] == bands[j]).any() and (registers[i] == registers[j]).sum() >= least and min(sizes[i], sizes[j]) * 100 >= 55 * max(sizes[i], sizes[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


TEXT = "Some words of the text, and more of them, as they come. "


def test_marked_articles_are_a_prior_alone():
    paragraphs = "".join(f"<p>{TEXT * k}</p>" for k in (3, 5, 4, 6))
    want = "\n\n".join(["Real", *((TEXT * k).strip() for k in (3, 5, 4, 6))])
    cards = "".join(f"<article><h3>Card {k}</h3><p>Short teaser, read on.</p></article>" for k in range(6))
    links = "<ul>" + "".join(f'<li><a href="/{k}">Next {k}</a></li>' for k in range(6)) + "</ul>"
    for page in (
        f"<body>{cards}<div><h1>Real</h1>{paragraphs}</div></body>",  # cards alone are marked
        f"<body><main><div><h1>Real</h1>{paragraphs}</div>{cards}</main></body>",
        f"<body><main><h1>Real</h1>{paragraphs}{links}</main></body>",
        f"<body><article><h1>Real</h1>{paragraphs}<div><h3>Read next</h3>{links}</div></article><div><p>Elsewhere, a few words.</p></div></body>",
        f"<body><main><article><h1>Real</h1>{paragraphs}</article><section><h2>More</h2>{links}</section></main></body>",
    ):
        assert html_extract.main_text(page) == want, page[:60]
    # A page of several articles of like size is their text.
    several = "".join(f"<article><h2>Part {k}</h2><p>{TEXT * 3}</p></article>" for k in range(4))
    assert html_extract.main_text(f"<body>{several}</body>") == "\n\n".join(x for k in range(4) for x in (f"Part {k}", (TEXT * 3).strip()))
    assert html_extract.main_text('<article><h1><a href="/">Only a title</a></h1></article>') == "Only a title"
    assert html_extract.main_text(f"<article></article><p>{TEXT}</p>") == TEXT.strip()


def brute_paths(kept):
    """The paths that stay, ratio by ratio as the method says, with nothing summed before it is asked for."""
    def ratio(path, of):
        own = [n for n in kept if n[0] == path]
        return sum(of(n) for n in own) / len(own)

    length = [ratio(p, lambda n: min(n[2], len(n[1]))) for p, *_ in kept]
    marks = [ratio(p, lambda n: sum(c in html_extract.PUNCTUATION for c in n[1]) if n[2] else 0) for p, *_ in kept]

    def smooth(values, k):
        weights = {j: np.exp(-((j - k) ** 2) / 2) for j in range(k - 2, k + 3) if 0 <= j < len(values)}
        return sum(w * values[j] for j, w in weights.items()) / sum(weights.values())

    score = [n[3] * np.sqrt(smooth(length, k) * (1 + smooth(marks, k))) for k, n in enumerate(kept)]
    mean = {p: np.mean([s for s, n in zip(score, kept) if n[0] == p]) for p, *_ in kept}
    least = 0.25 * min(60.0, max(mean.values()))
    return {p for p in mean if mean[p] >= least and any(min(n[2], len(n[1])) for n in kept if n[0] == p)}


def test_paths_are_chosen_as_by_plain_ratios():
    r = random.Random(7)
    for _ in range(200):
        kept = []
        for _ in range(r.randrange(1, 40)):
            text = " ".join(r.choices(["word", "a", "is,", "this.", "and", "long–er", "&"], k=r.randrange(1, 60)))
            kept.append((r.choice(["p", "li", "div/p", "h1", "td"]), text, r.choice([0, len(text), len(text) // 2]), r.choice([1.0, 1.0, 8.0, 0.2])))
        assert html_extract.chosen(kept) == brute_paths(kept)
    assert html_extract.chosen([]) == set()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables aren't here")
def test_pages_read_alike_without_their_marks(spark):
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        assert html_extract.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")) == html_extract.main_text(page)


def test_few_rows_need_no_python_workers(spark):
    rows = [(1, "a"), (None, None), (3, "é")]
    got = common.few_rows(spark, rows, "id long, name string")
    assert [tuple(r) for r in got.collect()] == rows and got.dtypes == [("id", "bigint"), ("name", "string")]
    assert common.few_rows(spark, [], "id long, name string").count() == 0
    index = spark.range(1).select(F.lit(1).alias("key"), F.lit(0).alias("gram"))
    met = secret_scan.candidates(index, {0: [frozenset(["abc"])]}, ["abc"])
    assert [r["key"] for r in met.collect()] == [1]
    for df in (got, met):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()  # rows that Python workers turn into Spark's


def test_batches_of_texts_are_small(spark):
    """Each batch is held some times over on both sides, in pieces that a heap of small regions has to grow for."""
    docs = spark.range(0, 800, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    make = lambda: lambda columns: [[len(columns[0])], [sum(map(len, columns[1]))]]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        got = common.map_blocks(docs, make, "n long, bytes long", block=10**6).collect()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert sum(r["n"] for r in got) == 800 and sum(r["bytes"] for r in got) == 8_000_000
    assert max(r["bytes"] for r in got) <= 3 << 20


def test_packing_holds_every_token_once(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = packing.pack_documents(odd, WORDS, capacity=64).collect()
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        of = [r for r in rows if r["doc_id"] == key]
        times = 3 if key == 3 else 1
        want = [(k, 64 * k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for k, part in enumerate(ids[i : i + 64] for i in range(0, len(ids), 64))] * times
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of) == sorted(want), text
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        ends = list(itertools.accumulate((n for _, n in sorted(held)), initial=0))
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_packing_remembers_words_up_to_a_bound_in_bytes():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, plain = packing.word_ids(path, most_bytes=20_000), packing.word_ids(path)
    for k in range(2_000):
        text = f"word{k} some{k}thing the of {k}"
        assert ids.ids(text) == plain.ids(text)
    for known in (ids, ids.parts):
        assert sum(sys.getsizeof(w) + sys.getsizeof(got) for w, got in known.items()) <= 20_000
    assert packing.word_ids(path) is not packing.word_ids(path)  # what a task remembers goes with it


def test_packing_keeps_frequent_words_among_rare_ones(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    asked, library = [], packing.word_ids(path).parts.library

    class Model:
        def tokenize(self, part):
            asked.append(part)
            return library.model.tokenize(part)

    class Library:
        model, encode = Model(), staticmethod(library.encode)

    monkeypatch.setitem(packing._LOADED, path, Library())
    ids = packing.word_ids(path, most_bytes=60_000)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:06d}")
    texts = [f"The quick brown fox, the {name(k)} and {name(k)}." for k in range(2_000)]
    for text in texts:
        assert ids.ids(text) == struct.pack(f"<{len(got := library.encode(text, add_special_tokens=False).ids)}I", *got)
    assert asked.count("quick") == 1  # asked for all the time, so never driven out
    assert len(asked) <= len(texts) + 10  # a new word is looked up once, as a word and as a part of one


def test_packing_looks_words_of_many_texts_up_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    asked, library = [], packing.word_ids(path).parts.library

    class Model:
        def tokenize(self, part):
            asked.append(part)
            return library.model.tokenize(part)

    class Library:
        model, encode = Model(), staticmethod(library.encode)

    monkeypatch.setitem(packing._LOADED, path, Library())
    ids = packing.word_ids(path, most_bytes=0)  # nothing but the last words are remembered
    texts = ["Quarry stones\tsplit  cleanly", "", "stones split, stones split...", "北京 <|x", " it's\xa0l'été 12 a.b. C#!? ", "split"] * 40
    assert ids.of_texts(texts) == [struct.pack(f"<{len(got := library.encode(t, add_special_tokens=False).ids)}I", *got) for t in texts]
    assert {w: asked.count(w) for w in ("quarry", "cleanly")} == {"quarry": 1, "cleanly": 1}
    assert asked.count("split") <= 3  # alone and with either kind of signs


def test_packing_leaves_odd_texts_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.word_ids(path)
    library = ids.parts.library
    for text in ["Plain, it's 1999", "ª º µ ß ÿ Ŀ ǅ ²½ naïve", "a\x1cb", "a\x85b", "a\x1f", "<|endoftext|> a", "İstanbul", "e\u0301", "ΑΣ 北京", "\x00 \x7f \xa0 \xad"]:
        got = library.encode(text, add_special_tokens=False).ids
        assert ids.ids(text) == struct.pack(f"<{len(got)}I", *got), text
    assert [ids.parts.odd(t) for t in ("naïve", "ǅ", "a\x1c", "\x85", "<|", "é<|", "İ", "ɐ")] == [False, False, True, True, True, True, True, True]


def test_packing_is_tight():
    r = random.Random(5)
    lengths = [min(4095, int(r.expovariate(1 / 900)) + 1) for _ in range(5000)]
    assert len({b for b, _ in packing.pack(lengths, 4096)}) <= 1.005 * -(-sum(lengths) // 4096) + 1
    assert len({b for b, _ in packing.pack([60, 60, 40, 40], 100)}) == 2  # larger items take the largest partner that fits


def test_leaks_are_those_of_plain_containment(spark, odd, empty):
    items = [(k, " ".join(prose(100 + k, n, 10**6))) for k, n in enumerate([3, 5, 8, 30, 60, 200, 700])] + [(50, ""), (51, None), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for k in range(40):
        words = prose(k, 1500 if k % 5 else 40, 10**6)
        item = (items[k % 7][1]).split()
        if k % 4 == 1:
            item[len(item) // 2] = "other"  # an edit in the middle
        docs.append((k, " ".join(words[:20] + (item if k % 3 else item[: len(item) // 2]) + words[20:]).upper() if k % 2 else " ".join(words + item)))
    docs += [(40, None), (41, ""), (0, docs[0][1]), (None, items[4][1])]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        asked = (item or "").lower().split()
        if i is not None and asked:
            n = min(5, len(asked))
            shared = len(grams(asked, n) & grams((text or "").lower().split(), n))
            if 100 * shared >= 75 * len(grams(asked, n)):
                want.add((d, i, shared))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.find_leaks(frame, tests).collect()} == want and len(want) > 10
    clean = decontaminate.without_leaks(frame, tests)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want} and clean.columns == frame.columns
    assert decontaminate.without_leaks(odd, tests).count() == odd.count() and decontaminate.find_leaks(empty, tests).count() == decontaminate.find_leaks(odd, tests.limit(0)).count() == 0


LANGUAGES = {"xx": "bada gado lima nura", "yy": "strek prilt knosk vrund", "zz": "aiou eoia iuae ouea"}


def test_languages_and_mixtures(spark, odd, empty):
    r = random.Random(4)
    text = lambda lang, n: " ".join("".join(r.sample(r.choice(LANGUAGES[lang].split()), 4)) for _ in range(n))
    rows = [(k, text(lang, 50), lang) for k, lang in enumerate(list(LANGUAGES) * 40)] + [(900, "?", None), (901, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logs = lang_id.learn(docs.where(fold_of("doc_id", 5) != 0))
    assert names == ["xx", "yy", "zz"]
    tested = spark.createDataFrame([(1, text("yy", 30), "score"), (2, text("xx", 80) + " " + text("zz", 40), ""), (3, None, ""), (4, "123 !?", ""), (5, "", "")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in lang_id.predict(tested, names, logs).collect()}
    assert got[1]["lang_pred"] == "yy" and got[1]["score"] > 0.95 and got[2]["lang_pred"] == "xx" and 0.5 < got[2]["score"] < 0.85 and "zz:0.3" in got[2]["mixture"]
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (3, 4, 5)] == [("und", 0.0)] * 3
    held = [r for r in lang_id.predict(docs, names, logs, more={"lang": F.col("lang")}).collect() if r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert lang_id.predict(odd, names, logs).count() == odd.count() and lang_id.predict(empty, names, logs).count() == 0
    assert lang_id.learn(empty.withColumn("lang", F.lit("x")))[0] == [] and lang_id.predict(tested, [], np.zeros((lang_id.BUCKETS, 0), np.float32)).first()["lang_pred"] == "und"


def test_url_verdicts(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://example.org", "http://org/", "ftp://x.com/fr/", "http://x.com/de/#y", "http://notexample.org/es/", "http://com/de", "nourl", None, "http://org?/x", "x://a://b/", "http://x.com:80/fr/", "http://x.com/fr\n/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(0, urls[0], "x", "y"), (None, urls[4], "x", "y")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, ("org", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, rule, verdict

    want = sorted([(str(k), *brute(u)) for k, u in enumerate(urls)] + [("0", *brute(urls[0])), ("None", *brute(urls[4]))], key=str)
    assert sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()), key=str) == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_fingerprints_follow_descending_ids(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RUN_ROWS", 7)  # several runs
    texts = {k: " ".join(prose(k, 5 + 7 * k, 300)) for k in range(60)} | {60: "", 61: "é", 62: None}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, n_chars int").repartition(5)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, key in enumerate(order):
        text, after = texts[key] or "", texts[order[(k + 1) % len(order)]] or ""
        new = fingerprint.edited(text, after)
        assert len(text) // 3 == 0 or new != text
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.digest(text), fingerprint.digest(new))
        assert r["near_next"] == fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(after))
    assert fingerprint.likeness(fingerprint.digest("abc"), fingerprint.digest("abc")) == 1.0
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(empty).count() == 0
    lone = fingerprint.fingerprints(docs.where("doc_id = 5")).first()
    assert lone["near_next"] == 1.0


def plain_digest(text):
    """The digest with plain integers: one window after the other."""
    data = text.encode()
    if not data:
        return "00" * 67
    padded = data + bytes(max(0, 4 - len(data)))
    counts = [0] * 256
    for k in range(len(padded) - 3):
        a, b, c, d = padded[k : k + 4]
        first, near, far, last = a * 0x9E3779B1, b * 0x85EBCA77, c * 0xC2B2AE3D, d * 0x27D4EB2F
        for x in (first + near + far, (first + near + last) % 2**32 ^ 0x5BD1E995, (first + far + last) % 2**32 ^ 0x2545F491):
            x %= 2**32
            x ^= x >> 15
            counts[x * 0x2C1B3C6D % 2**32 >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    out = [min(255, 1 + round(12 * np.log(len(data)))), min(255, 255 * q1 // max(1, q3)), min(255, 255 * q2 // max(1, q3))]
    for k in range(0, 256, 4):
        out.append(sum(((n > q1) + (n > q2) + (n > q3)) << s for n, s in zip(counts[k : k + 4], (6, 4, 2, 0))))
    return bytes(out).hex()


def plain_likeness(one, other):
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    if a == b:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    steps = 0
    for x, y in zip(a[3:], b[3:]):
        for s in (0, 2, 4, 6):
            n = abs((x >> s & 3) - (y >> s & 3))
            steps += 6 if n == 3 else n
    far = steps + abs(a[0] - b[0]) + (abs(a[1] - b[1]) + abs(a[2] - b[2])) // 16
    return max(0.0, 1 - max(far, 1) / 420)


def test_digests_are_those_of_plain_counts():
    r = random.Random(9)
    texts = ["", "a", "abc", "é日😀", "x" * 999, *(" ".join(prose(k, r.randrange(1, 400), 90)) for k in range(25))]
    prints = [fingerprint.digest(t) for t in texts]
    assert prints == [plain_digest(t) for t in texts]
    for a, b in itertools.product(prints[:12], prints):
        assert fingerprint.likeness(a, b) == pytest.approx(plain_likeness(a, b))


def test_one_ids_rows_are_split_over_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RUN_ROWS", 5)
    rows = [(7, f"text {k} of seven") for k in range(40)] + [(None, f"no id {k}") for k in range(30)] + [(k, f"own {k}") for k in range(20) if k != 7] + [(3, "same")] * 25
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = fingerprint.in_runs(docs, "doc_id").where("not more").groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).collect()
    assert max(r["texts"] for r in runs) <= 25 and sum(r["n"] for r in runs) == len(rows)
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in rows)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = {(i, hashlib.sha256(fingerprint.edited(t, u).encode()).hexdigest()) for i, t in rows for j, u in rows if j == i or (order.index((i, t)) <= order.index((j, u)))} | {(None, hashlib.sha256(fingerprint.edited(t, u).encode()).hexdigest()) for i, t in rows if i is None for _, u in rows}
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} <= want


def test_equal_languages_go_by_the_alphabet(spark):
    rows = [(k, "bada gado lima nura", lang) for k, lang in enumerate(["zz", "aa", "mm"] * 3)] + [(20, "strek prilt", "bb"), (20, "strek prilt", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logs = lang_id.learn(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in lang_id.predict(docs, names, logs).collect()}
    assert names == ["aa", "bb", "mm", "zz"] and got == {(k, "aa") for k in range(9)} | {(20, "bb")}


def plain_mixture(grams, logs):
    """Proportions chosen for one document, trigram by trigram."""
    n, languages = len(grams), logs.shape[1]
    like = [[float(np.exp(logs[g, k] - logs[g].max())) for k in range(languages)] for g in grams.tolist()]

    def fitted(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(languages)]
        for _ in range(lang_id.ROUNDS):
            new = [0.0] * languages
            for row in like:
                total = sum(s * x for s, x in zip(share, row))
                for k in range(languages):
                    new[k] += share[k] * row[k] / total / n
            share = new
        return share, sum(np.log(sum(s * x for s, x in zip(share, row))) for row in like)

    share, _ = fitted(range(languages))
    order = sorted(range(languages), key=lambda k: -share[k])
    alone = [sum(np.log(row[k]) for row in like) for k in range(languages)]
    best = max(range(languages), key=lambda k: alone[k])
    chosen, value = [float(k == best) for k in range(languages)], alone[best]
    for size in range(2, languages + 1):
        allowed = set(order[:size]) | ({best} if size == 2 else set())
        share, score = fitted(allowed)
        score -= lang_id.PRICE * (size - 1) * np.log(n + 1)
        if score <= value:
            break
        chosen, value = share, score
    return chosen


def test_mixtures_are_those_of_plain_em():
    r = np.random.default_rng(2)
    logs = np.log(r.dirichlet(np.full(50, 0.3), 4).T + 1e-4).astype(np.float32)
    table = np.zeros((lang_id.BUCKETS, 4), np.float32)
    table[:50] = logs
    docs = [np.concatenate([r.choice(50, n, p=np.exp(logs[:, k]) / np.exp(logs[:, k]).sum()) for k, n in parts]).astype(np.uint32) for parts in ([(0, 200)], [(1, 150), (2, 90)], [(0, 120), (1, 120), (3, 120)], [(2, 5)], [(3, 1)])]
    got, _ = lang_id.infer(docs, table)
    for k, doc in enumerate(docs):
        assert got[k] == pytest.approx(plain_mixture(doc, table), abs=1e-4)


def test_contained_items_are_found_whatever_the_sizes(spark):
    """Recall of the search against plain containment, for items of 1 to 500 shingles in documents that share from little to much with other items; at least 0.99."""
    r = random.Random(12)
    items = [(k, " ".join(prose(10_000 + k, r.choice((1, 3, 5, 8, 12, 20, 35, 60, 150, 504)), 10**6))) for k in range(120)]
    docs, held = [], set()
    for d in range(150):
        words = prose(20_000 + d, r.choice((50, 400, 3000)), 10**6)
        for k in r.sample(range(120), r.choice((0, 1, 1, 2, 10, 40))):
            item = items[k][1].split()
            if len(item) > 12 and r.random() < 0.5:  # five shingles go, of those that may
                at = r.randrange(len(item))
                item[at] = "edited"
            words += item if r.random() < 0.7 else item[: len(item) * 6 // 10]
            words += ["between"]
        docs.append((d, " ".join(words)))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    of_doc = {d: t.split() for d, t in docs}
    for i, text in items:
        asked = text.split()
        n = min(5, len(asked))
        own = grams(asked, n)
        for d, words in of_doc.items():
            if 100 * len(own & grams(words, n)) >= 75 * len(own):
                held.add((d, i))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= held and len(got) >= 0.99 * len(held) and len(held) > 300


def test_sketches_are_least_hashes_of_equal_parts():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 65, 1000):
        own = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        e = decontaminate.partition(len(own))
        assert (1 << e) >= len(own) > (1 << e) // 2
        parts = {}
        for h in own.tolist():
            parts[h * 2 * (1 << e) >> 64] = min(h, parts.get(h * 2 * (1 << e) >> 64, h))
        assert decontaminate.sketch(own, e).tolist() == sorted(parts.values())
    assert decontaminate.sketch(np.empty(0, np.uint64), 0).tolist() == []


def test_words_are_split_at_ascii_white_space():
    assert word_bytes("A\tb\x0bC\u00a0d É") == ["a".encode(), b"b", "c\u00a0d".encode(), "É".encode()] and word_bytes(None) == []
