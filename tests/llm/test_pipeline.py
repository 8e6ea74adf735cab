"""The pipeline's stages on a small fixture, against a plain version of each, and on empty tables, repeated ids and clashing names."""

from __future__ import annotations

import re

import public_tokenizers
import pytest

import corpus_pipeline
from quarry.llm import toxicity
from quarry.llm.queries import toxicity_model
from tests.llm.test_text_operators import prose, toxic_rows

CLASHING = ["_key", "_word", "_bits", "_maybe", "_near_id", "_near_row", "row", "key", "id", "number", "a.b", "spans", "score", "predicted", "rules", "masked"]


def write(spark, folder, rows, leaks, more=()):
    """documents with the columns ``more`` beside theirs, labels and benchmark."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in more)
    spark.createDataFrame([(*r, *(f"{c} {k}" for c in more)) for k, r in enumerate(rows)], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in toxic_rows(240)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(leaks, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def shingles(text, size=5):
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    size = min(size, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def near_copies_out(rows):
    """The rows without those that reach one of a smaller id; rows of an id with one text are one."""
    rows = list(dict.fromkeys(rows))
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [r for k, r in enumerate(rows) if r[0] is None or r[0] == least[root(k)]]


def leaks_out(rows, leaks):
    asked = [shingles(t) for i, t in leaks if i is not None and shingles(t)]
    return [r for r in rows if not any(100 * len(a & shingles(r[1], len(next(iter(a))))) >= 75 * len(a) for a in asked)]


SECRET = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")


def masked(rows):
    out = []
    for r in rows:
        text = SECRET.sub("[SECRET]", r[1]) if r[1] else r[1]
        out.append((r[0], text, *r[2:4], len(text) if text != r[1] else r[4], *r[5:]))
    return out


def fixture():
    rows = [(k, t, "xx", "src", len(t)) for k, t, _ in toxic_rows(240)]
    leak = " ".join(prose(5000, 40, 10**6))
    secret = "key token=abcdefgh1234 " + " ".join(prose(5001, 60)) + " AKIA" + "Z" * 16
    rows += [(300, rows[1][1], "xx", "s", 1), (301, "intro " + leak, "xx", "s", 1), (302, secret, "xx", "s", len(secret)), (303, None, None, None, None), (304, "", "xx", "s", 0)]
    rows += [(305, rows[4][1] + " one more", "xx", "s", 2), (306, " ".join(prose(5002, 300)), "xx", "s", 3), (None, "no id, kept", "xx", "s", 4), (None, "intro " + leak, "xx", "s", 4)]
    return rows, [(1, leak), (2, ""), (None, "one more")]


@pytest.mark.parametrize("more", [(), CLASHING])
def test_pipeline_is_that_of_plain_stages(spark, tmp_path, more):
    rows, leaks = fixture()
    write(spark, tmp_path, rows, leaks, more)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    network = toxicity_model(spark, str(tmp_path))
    slope, offset = network.line
    score = lambda t: 1 / (1 + 2.718281828459045 ** -(slope * float(toxicity.score_texts(network, [t])[0]) + offset))
    want = [r for r in rows if score(r[1]) < 0.7]
    assert {r[0] for r in want if r[0] is not None and r[0] < 240} == {k for k in range(240) if k % 3}
    plain = {"toxicity": lambda x: want, "near_dedup": near_copies_out, "decontamination": lambda x: leaks_out(x, leaks), "secrets": masked}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        want = plain[name](want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *more]
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
    assert len(want) < 170 and "[SECRET]" in next(r[1] for r in want if r[0] == 302)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((r[0] is None, r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in want)
    whole: dict = {}
    for p in packed:
        assert p["length"] <= 4096 and p["start"] == 4096 * p["piece"]
        whole.setdefault(p["doc_id"], []).append(p["length"])
    assert sorted((i is None, i or 0, sum(n)) for i, n in whole.items()) == sorted({(a, b): (a, b, sum(n for x, y, n in sizes if (x, y) == (a, b))) for a, b, _ in sizes}.values())
    for s in {p["sequence_id"] for p in packed}:
        at = 0
        for p in sorted((p for p in packed if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_ids_that_stand_on_several_rows(spark, tmp_path):
    text, other = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    rows = [(1, text, "x", "s", 1), (1, text, "x", "s", 1), (2, text + " end", "x", "s", 1), (2, other, "x", "s", 1), (3, other, "x", "s", 1), (None, text, "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(0, text), (1, text), (2, other)])


def test_pipeline_of_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
