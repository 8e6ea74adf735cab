"""Ranked search, SimHash groups and the filter audit against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import filter_audit, ranked_search, simhash

ODD = [None, "", " \t\n", "one", "Two words", "é à ü ß ñ 日本語 😀 x", "\x00\x1c\x85 \x7f", "word " * 30_000, "A" * 5000, "KK İ"]
CLASHING = "id string, n string, terms string, shard string, asks string, rep string, print string, part string, number string, bits string"


def table(spark, rows, name="doc_id", more=""):
    """Rows (id, text, ...) beside columns that are called like the operators' own."""
    own = f"{name} long, text string{more}"
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{own}, {CLASHING}")


def brute_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, t in held:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in wanted if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    return [(k, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(300)], k=r.randrange(1, 120)))) for k in range(n)]


@pytest.mark.parametrize("shard", [500_000, 700])
def test_ranks_are_those_of_scoring_everything(spark, shard):
    rows = corpus(1, 400)
    rows += [(500 + k, t) for k, t in enumerate(ODD)] + [(k + 1000, rows[7][1]) for k in range(25)] + [(7, rows[7][1]), (7, "w1 w2"), (None, rows[7][1]), (None, "w250 W250")]
    items = [(1, "w1 W7 w250"), (2, rows[7][1]), (3, None), (4, "nothing of this"), (5, ""), (6, "w3 日本語"), (6, "w299!"), (None, "w0"), (8, "w0 w0 w1")]
    got = ranked_search.rank_documents(table(spark, rows), table(spark, items, "item_id"), k=10, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(rows, items, 10)


def test_ranks_of_empty_tables(spark):
    rows, none = table(spark, [(1, "a b")]), table(spark, []).select("doc_id", "text")
    items = table(spark, [(1, "a")], "item_id")
    assert ranked_search.rank_documents(none, items).count() == 0
    assert ranked_search.rank_documents(rows, items.limit(0)).count() == 0
    assert ranked_search.rank_documents(table(spark, [(1, None), (2, " ")]), items).count() == 0


def test_reading_ends_when_all_is_resolved():
    r = np.random.default_rng(3)
    n = 20_000
    sizes = np.full(n, 3)
    counts = r.integers(1, 4, 3 * n)
    counts[: 3 * 20] = 60  # twenty documents stand out in every list
    shard = ranked_search.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), sizes, pa.array(["a", "b", "c"] * n), counts)
    got, read = shard.search(["a", "b", "c"], [50, 40, 30], 10)
    part = 10**9 * 60 // (1000 * 60 + 8 * 100)
    assert got == [(k, 120 * part) for k in range(10)] and read < 1000 < 3 * n
    # All tie: the order of the ids decides, for which everything has to be read.
    shard = ranked_search.Shard(np.arange(n)[::-1].copy(), np.ones(n, bool), np.full(n, 100), np.ones(n, np.int64), pa.array(["a"] * n), np.ones(n, np.int64))
    got, read = shard.search(["a", "zz"], [1, 9], 3)
    assert [shard.ids[d] for d, _ in got] == [0, 1, 2]


def brute_groups(prints, radius):
    """Of (id or None, fingerprint): the least id that each id reaches."""
    known = [(i, p) for i, p in prints if i is not None]
    own = {i: i for i, _ in known}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, (i, p) in enumerate(known):
        for j, q in known[a + 1 :]:
            if i == j or (p ^ q).bit_count() <= radius:
                x, y = root(i), root(j)
                own[max(x, y)] = min(x, y)
    return {i: root(i) for i in own}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_simhash_groups_are_those_of_all_pairs(spark, most):
    r = random.Random(5)
    texts = [" ".join(f"v{r.randrange(60)}" for _ in range(r.randrange(1, 200))) for _ in range(60)]
    for base in range(20):
        for _ in range(12):  # near copies: a word or two differ
            words = texts[base].split()
            words[r.randrange(len(words))] = f"v{r.randrange(60)}"
            texts.append(" ".join(words))
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)] + [(5000 - k, t) for k, t in enumerate(ODD)] + [(9000 + k, texts[0].upper()) for k in range(40)]
    rows += [(None, texts[0]), (None, "other"), (1, texts[0]), (4, texts[40]), (4, texts[41])]
    got = simhash.simhash_groups(table(spark, rows), most=most).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    own = brute_groups(prints, 2)
    want = sorted(((i, f"{p:016x}", own.get(i)) for i, p in prints), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for *_, c in want}) < len({i for i, *_ in want}) - 60


def test_simhash_of_empty_tables(spark):
    assert simhash.simhash_groups(table(spark, []).select("doc_id", "text")).count() == 0
    assert [tuple(x) for x in simhash.simhash_groups(table(spark, [(None, "a")])).collect()] == [(None, f"{brute_print('a'):016x}", None)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(2, 30))
def test_vantage_point_trees_find_every_pair(seed, centers, parts):
    r = np.random.default_rng(seed)
    middle = r.integers(0, 1 << 63, centers, dtype=np.uint64) * np.uint64(2)
    points = middle[r.integers(0, centers, 300)]
    for _ in range(3):
        points = points ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) * r.integers(0, 2, 300).astype(np.uint64)
    points = np.unique(points)
    tree = simhash.Tree()
    tree.divide(0, points[::3], parts)
    tree.divide(0, points[1::3], 3)  # a shard that is divided once more
    seen, pairs = [], set()
    for _, own, visitors in tree.deal(points, 2):
        seen += own.tolist()
        near = simhash.distance(points[own][:, None], points[np.concatenate([own, visitors])]) <= 2
        pairs |= {frozenset((int(own[a]), int(np.concatenate([own, visitors])[b]))) for a, b in zip(*np.nonzero(near), strict=True)}
        groups, met = simhash.linked(points[own], points[visitors], 2)
        graph = near[:, : len(own)]
        for a in range(len(own)):  # a group is what its least point reaches
            reach, todo = set(), [a]
            while todo:
                if (x := todo.pop()) not in reach:
                    reach.add(x)
                    todo += np.flatnonzero(graph[x]).tolist()
            assert groups[a] == min(reach)
        assert {(int(v), int(g)) for m in met for v, g in m.T} == {(int(b), int(groups[a])) for a, b in zip(*np.nonzero(near[:, len(own) :]), strict=True)}
    assert sorted(seen) == list(range(len(points)))
    far = simhash.distance(points[:, None], points) <= 2
    assert pairs >= {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(far), strict=True)}


def brute_audit(docs, labels):
    judged = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        judged.append((part or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = []
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        share = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(removed)
                lines.append((f, (part, "".join(order), step, len(left), len(removed), sum(f in x[1] for x in own) - len(removed), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed))))
        out += [(*line, share[f]) for f, line in lines]
    return sorted(out)


@pytest.mark.parametrize("bits", [16, 3])
def test_audit_is_that_of_applying_the_filters(spark, bits):
    r = random.Random(8)
    texts = ODD + [" ".join(r.choices([f"x{k}" for k in range(r.choice((20, 200)))], k=r.randrange(30, 90))) + r.choice(("", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for _ in range(60)]
    docs = [(r.randrange(200) if r.random() < 0.95 else None, r.choice(texts), r.choice(["a", "a", "a", "b", "", None])) for _ in range(250)]
    docs += [(300, None, "c"), (301, "", "c"), (300, None, "c")]
    labels = [(r.randrange(200) if r.random() < 0.9 else None, r.choice((0, 1, None)), r.choice((0, 1, None))) for _ in range(120)]
    frame = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in docs], "doc_id long, text string, source string, part string, number string, fails string, quality string")
    got = filter_audit.audit(frame, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, source string"), range_bits=bits)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


numbers = st.lists(st.integers(0, 80), unique=True).map(sorted)


@given(st.lists(numbers, max_size=5), numbers, numbers)
def test_galloping_merges(lists, a, b):
    assert filter_audit.merged(lists) == sorted(set().union(*lists))
    assert filter_audit.without(a, b) == sorted(set(a) - set(b)) and filter_audit.shared(a, b) == len(set(a) & set(b))
    for x in range(-1, 82):
        assert filter_audit.leap(a, x, 0) == sum(y < x for y in a)
