"""Ranked lexical search with no random access (NRA).

A text's terms are its runs of letters and digits (ASCII) and of all characters beyond ASCII, with A-Z lower-cased. A
first pass writes each document's length and the counts of its terms that an item asks for; document frequencies and
the corpus' size come from there. Documents are dealt into shards, in which each term has a posting list sorted by impact.
Every item meets every shard: its lists are read from the top in growing blocks, each document has a lower bound (what
was read of it) and an upper bound (the last impact read of each list that it hasn't shown up in), and reading goes
on until no document outside the best ones can pass them, not even by a tie, and the best ones' scores are whole. The
best of the shards are ranked once more. A shard holds some hundred thousand postings, whatever the number of documents.

Each row of the documents is a document of its own: rows that share an id are ranked one by one, equal rows next to
each other. Null and empty texts and those without a term count nowhere and are never found. Documents without an id come last among
equal scores. Items that share an id are one item with the terms of all; items without an id are one, items without
terms find nothing. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BLOCK, checkpointed, id_and_text, map_blocks

#: Postings of a shard, and the postings of each list that are read at first; each further read takes twice as many.
SHARD, FIRST_READ = 500_000, 64
#: Bits of the bitmap of asked terms.
ASKED_BITS = 22

#: Bytes of UTF-8 that belong to terms, A-Z lower-cased; all others are blanks.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[str]:
    return [t.decode("utf-8") for t in term_bytes(text)]


def term_bytes(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split() if text else []


class Asked(dict):
    """Whether a term may be asked for, by a bitmap; answers are remembered up to a bound."""

    def __init__(self, words: np.ndarray, most: int = 200_000):
        self.words, self.most = words, most

    def __missing__(self, term: bytes) -> bool:
        place = xxhash.xxh3_64_intdigest(term) & (1 << ASKED_BITS) - 1
        value = bool(int(self.words[place >> 6]) >> (place & 63) & 1)
        if len(self) >= self.most:
            self.clear()
        if len(term) <= 64:
            self[term] = value
        return value


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""

    def make():
        def work(columns):
            ids, texts = columns
            return [ids, [sorted(set(terms_of(t))) for t in texts]]

        return work

    listed = map_blocks(id_and_text(items, id_col, text_col), make, f"{id_col} long, terms array<string>")
    return listed.select(F.col(id_col).alias("item"), F.explode("terms").alias("term")).distinct()


def bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the terms' hashes: at most 65,536 words, however many terms there are."""

    def make():
        def work(columns):
            place = np.array([xxhash.xxh3_64_intdigest(t.encode()) & (1 << ASKED_BITS) - 1 for t in columns[0]], np.int64)
            return [place >> 6, place & 63]

        return work

    bits = map_blocks(terms.select("term"), make, "word int, bit int").select("word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("bits"))
    words = np.zeros(1 << ASKED_BITS - 6, np.uint64)
    for word, value in bits.groupBy("word").agg(F.bit_or("bits")).collect():
        words[word] = value & (1 << 64) - 1
    return words


def forward_index(docs: DataFrame, words: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): each document's number of terms, and how often it holds each term that may be asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        asked = Asked(shared.value)

        def work(columns):
            ids, texts = columns
            out: list[list] = [ids, [], [], []]
            for t in texts:
                all_ = term_bytes(t)
                found = [(w.decode("utf-8"), k) for w, k in Counter(all_).items() if asked[w]]
                for to, x in zip(out[1:], (len(all_), [w for w, _ in found], [k for _, k in found]), strict=True):
                    to.append(x)
            return out

        return work

    return map_blocks(id_and_text(docs, id_col, text_col), make, f"{id_col} long, n long, terms array<string>, counts array<int>")


class Shard:
    """Posting lists sorted by impact. Documents are numbered in the order that breaks ties."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: pa.Array, counts: np.ndarray):
        """ids (whatever where not ``known``), damping m of each document, its number of postings; then the postings, document by document."""
        order = np.lexsort((ids, ~known))
        self.ids, self.known = ids[order], known[order]
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        coded = terms.dictionary_encode()
        self.codes = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        code, doc = np.asarray(coded.indices), np.repeat(number, sizes)
        part = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(lengths, sizes))
        by = np.lexsort((doc, -part, code))
        self.docs, self.parts = doc[by], part[by]
        self.starts = np.searchsorted(code[by], np.arange(len(self.codes) + 1))

    def search(self, terms: list[str], weights: list[int], k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (number of document, score) of positive scores, and how many postings were read."""
        lists = [(int(self.starts[c]), int(self.starts[c + 1]), w) for t, w in zip(terms, weights, strict=True) if w > 0 and (c := self.codes.get(t)) is not None]
        n = len(self.ids)
        lower, depth, step, read = np.zeros(n, np.int64), 0, FIRST_READ, 0
        best = np.empty(0, np.int64)
        last = [0] * len(lists)
        open_ = len(lists) > 0
        while open_:
            for i, (a, b, w) in enumerate(lists):
                low, high = a + depth, min(b, a + depth + step)
                if low < high:
                    lower[self.docs[low:high]] += w * self.parts[low:high]
                    read += high - low
                last[i] = w * int(self.parts[high - 1]) if high < b else 0  # what is left has no greater impact
            depth, step = depth + step, step * 2
            missing = np.full(n, sum(last))
            for (a, _, _), impact in zip(lists, last, strict=True):
                if impact:
                    missing[self.docs[a : a + depth]] -= impact
            best = self._best(lower, k)
            rivals = lower + missing
            rivals[best] = -1
            worst, place = lower[best[-1]], best[-1]
            upper = rivals.max()
            open_ = upper > worst or upper == worst and bool((np.flatnonzero(rivals == upper) < place).any())
            open_ = open_ and any(last)
        # Membership is decided. The lists go on being read until they have shown all of the best, or have ended.
        wanted = np.zeros(n, bool)
        wanted[best] = True
        for (a, b, w), impact in zip(lists, last, strict=True):
            if impact:
                at, size = a + depth, step
                missed = len(best) - int(wanted[self.docs[a:at]].sum())
                while missed and at < b:
                    docs = self.docs[at : min(b, at + size)]
                    hit = np.flatnonzero(wanted[docs])
                    lower[docs[hit]] += w * self.parts[at + hit]
                    missed, read, at, size = missed - len(hit), read + len(docs), at + len(docs), size * 2
        found = sorted(((int(d), int(lower[d])) for d in best if lower[d] > 0), key=lambda x: (-x[1], x[0]))
        return found, read

    @staticmethod
    def _best(lower: np.ndarray, k: int) -> np.ndarray:
        """The k documents of the greatest lower bounds, the first of equal ones."""
        if len(lower) > k:
            least = np.partition(lower, len(lower) - k)[len(lower) - k]
            above = np.flatnonzero(lower > least)
            some = np.concatenate([above, np.flatnonzero(lower == least)[: k - len(above)]])
        else:
            some = np.arange(len(lower))
        return some[np.lexsort((some, -lower[some]))]


def _search_shards(k: int):
    """Over rows sorted by shard, documents before items: (item, doc, known, score) of each item's best in each shard."""
    out = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for whole in batches:
            shards, asks = (np.asarray(whole.column(c)) for c in ("shard", "asks"))
            cuts = np.flatnonzero(np.diff(shards) | np.diff(asks)) + 1
            for low, high in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                if low == high:
                    continue
                batch = whole.slice(low, high - low)
                if shards[low] != at:
                    at, parts, shard = shards[low], [], None
                if not asks[low]:
                    parts.append(batch.select(["id", "m", "terms", "numbers"]))
                    continue
                if shard is None and parts:
                    shard, parts = _built(pa.Table.from_batches(parts).combine_chunks()), []
                if shard is None:
                    continue  # no documents here
                for first in range(0, batch.num_rows, BLOCK):
                    got = []
                    part = batch.slice(first, BLOCK)
                    for item, terms, weights in zip(*(part.column(c).to_pylist() for c in ("id", "terms", "numbers")), strict=True):
                        got += [(item, int(shard.ids[d]) if shard.known[d] else None, s) for d, s in shard.search(terms, weights, k)[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], pa.int64()) for c in range(3)], schema=out)

    return run


def _built(table: pa.Table) -> Shard:
    ids, m, terms, numbers = (table.column(c).combine_chunks() for c in ("id", "m", "terms", "numbers"))
    sizes = np.diff(np.asarray(terms.offsets))
    return Shard(np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null()), np.asarray(m), sizes, terms.flatten(), np.asarray(numbers.flatten()))


def damping(n: Column, documents: int, terms: int) -> Column:
    """m of a document of n terms."""
    return F.lit(10) + F.call_function("div", F.lit(90) * n * F.lit(documents), F.lit(terms))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, with scores above 0, by score and then id."""
    asked = checkpointed(item_terms(items, item_col, item_text))
    index = checkpointed(forward_index(docs, bitmap(asked), id_col, text_col))
    size = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    shards = max(1, -(-size["postings"] // shard))

    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * size["docs"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    asking = asked.join(held, "term").groupBy("item").agg(F.collect_list(F.struct("term", weight.cast("long").alias("weight"))).alias("t"))  # of one item
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    queries = asking.select("item", "t", everywhere).select("shard", F.lit(True).alias("asks"), F.col("item").alias("id"), F.lit(0).cast("long").alias("m"), F.col("t.term").alias("terms"), F.col("t.weight").alias("numbers"))
    rows = index.where(F.size("terms") > 0).select(
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col(id_col).alias("id"),
        damping(F.col("n"), size["docs"], max(1, size["terms"])).alias("m"), "terms", F.col("counts").cast("array<long>").alias("numbers"),
    )
    met = rows.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(_search_shards(k), "item long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return found.select(F.col("item").alias(item_col), rank.alias("rank"), F.col("doc").alias(id_col), "score").where(F.col("rank") <= k)


def oracle(k: int = 10) -> str:
    words = lambda text: rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    with d as (select row_number() over () as r, doc_id, {words('text')} as ts from documents where text is not null),
    sized as (select r, doc_id, ts, len(ts) as n from d where len(ts) > 0),
    total as (select count(*) as docs, sum(n)::bigint as terms from sized),
    tf as (select r, t, count(*) as tf from (select r, unnest(ts) as t from sized) group by r, t),
    asked as (select distinct item_id, unnest({words('text')}) as t from benchmark where text is not null),
    held as (select t, count(*) as df from tf group by t),
    weight as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from held, total),
    m as (select r, doc_id, (100 - 90 + ((90 * n * docs) // terms))::bigint as m from sized, total),
    scored as (
      select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from asked join weight using (t) join tf using (t) join m using (r) group by item_id, doc_id, r),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id asc nulls last, r) as rank, doc_id, score from scored where score > 0)
    select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {k}"""
