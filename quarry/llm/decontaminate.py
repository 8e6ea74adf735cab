"""Benchmark decontamination by size-partitioned MinHash containment search.

Of a document's set of shingles only those matter that some test item has; a bitmap of fixed size lets these pass (and few
others). Documents are partitioned by the size of what passes, u, to the next power of two. A partition's MinHash
sketch has 2u registers, each with the least hash of its share of the hash range, for documents and items alike. In
a partition, an item of q shingles that a document contains to the share t has a similarity of t q / (u + (1 - t) q) with it at least, so many of the
occupied registers are expected to be equal; pairs with four standard deviations fewer are no candidates. Candidates are
verified by exact containment: the share of the item's shingles, compared as words, that the document's whole text has.

Registers are posted and joined by partition and hash. Documents with a hash are dealt into ``SALTS`` parts, which the items' postings go to each, so that a
shingle which stands in most documents meets in no single task. Items of fewer than ``SMALL`` shingles have no shorter sketch than their set and are
looked for by all of them.

Shingles have five words; an item with fewer words is one shingle of them all, looked for among the document's
shingles of as many words. Items without a word match nothing, nor do null or empty texts. Repeated rows count as one
document; rows with one id and different texts are each searched, and the greater containment holds; hits of rows
without an id have a null id. Items without an id are left out. Other columns aren't read, and kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WordHashes, checkpointed, id_and_text, map_blocks, narrowed, shingle_hashes, signed, without, word_bytes
from quarry.plans.spec import quoted

SIZE = 5
#: Items of fewer shingles are looked for by their whole sets.
SMALL = 8
#: Registers for each shingle of a partition's largest document, and how far below the expected number of equal ones a candidate may be.
REGISTERS, DEVIATIONS = 2, 4.0
#: Parts of the documents that share a hash.
SALTS = 16
#: Bits of the bitmaps over items' hashes: 2 MB, however many items there are.
BITS = 24
#: Stands for the partition of whole sets.
WHOLE = -1


def partition(n: np.ndarray | int):
    """The exponent of the power of two that a set of n hashes is sketched for."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int32) if isinstance(n, np.ndarray) else max(0, int(n - 1).bit_length())


def sketch(h: np.ndarray, exponent: int) -> np.ndarray:
    """The registers of a sorted set of hashes: the least hash in each equal part of the range, of which there are 2 * 2 ** exponent."""
    shift = np.uint64(64 - exponent - (REGISTERS.bit_length() - 1))
    return h[np.flatnonzero(np.diff(h >> shift, prepend=np.uint64((1 << 64) - 1)) != 0)] if len(h) else h


def least_equal(q: int, exponent: int, percent: int) -> int:
    """The equal registers that an item of q shingles has at least with a document of the partition that contains it to that percentage."""
    u, t = float(1 << exponent), percent / 100
    union = u + max(0.0, 1 - t) * q
    similarity, registers = t * q / union, REGISTERS * u
    occupied = registers * (1 - math.exp(-union / registers))
    expected, kept = similarity * occupied, occupied / union
    return max(1, math.floor(expected - DEVIATIONS * math.sqrt(expected * (1 - kept))))


def item_postings(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n, hash): all shingles of each item; words is their length, n their number."""

    def make():
        hashes = WordHashes()

        def work(columns):
            out = [[], [], [], []]
            for key, text in zip(*columns, strict=True):
                words = word_bytes(text)
                if key is None or not words:
                    continue
                own = shingle_hashes(words, hashes, SIZE)
                for column, values in zip(out, ([key] * len(own), [min(SIZE, len(words))] * len(own), [len(own)] * len(own), signed(own).tolist()), strict=True):
                    column.extend(values)
            return out

        return work

    return map_blocks(id_and_text(items, id_col, text_col), make, "item long, words int, n int, hash long")


def item_sketches(items: DataFrame, id_col: str, text_col: str, exponents: list[int], percent: int) -> DataFrame:
    """(item, part, least, hash): each item's registers for each partition of documents, or all of its shingles."""

    def make():
        hashes = WordHashes()

        def work(columns):
            out = [[], [], [], []]
            for key, text in zip(*columns, strict=True):
                words = word_bytes(text)
                if key is None or not words:
                    continue
                own = shingle_hashes(words, hashes, SIZE)
                n = len(own)
                some = [(WHOLE, max(1, -(-percent * n // 100)), own)] if n < SMALL else [(e, least_equal(n, e, percent), sketch(own, e)) for e in exponents]
                for part, least, registers in some:
                    for column, values in zip(out, ([key] * len(registers), [part] * len(registers), [least] * len(registers), signed(registers).tolist()), strict=True):
                        column.extend(values)
            return out

        return work

    return map_blocks(id_and_text(items, id_col, text_col), make, "item long, part int, least int, hash long")


def _bitmap(postings: DataFrame) -> np.ndarray:
    """One bit for each place that a sketched hash falls on."""
    place = F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1))
    words = postings.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toPandas()  # at most 2**18 rows
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint8)


def document_postings(rows: DataFrame, large: np.ndarray, small: np.ndarray, sizes: list[int]) -> DataFrame:
    """(key, part, hash): the registers of what the bitmap of large items lets pass of every whole text, and all that the small items' one does, for shingles of the given sizes."""
    shared = rows.sparkSession.sparkContext.broadcast([large, small])

    def make():
        hashes, (held, held_small) = WordHashes(), shared.value

        def passing(own, bits):
            place = (own & np.uint64((1 << BITS) - 1)).astype(np.int64)
            return own[bits[place >> 3] >> (place & 7).astype(np.uint8) & np.uint8(1) != 0]

        def work(columns):
            keys, parts, found = [], [], []

            def post(key, part, own):
                if len(own):
                    keys.append(np.full(len(own), key, np.int64))
                    parts.append(np.full(len(own), part, np.int32))
                    found.append(signed(own))

            for key, text in zip(*columns, strict=True):
                words = word_bytes(text)
                whole = shingle_hashes(words, hashes, SIZE) if len(words) >= SIZE else None
                if whole is not None:
                    own = passing(whole, held)
                    post(key, partition(len(own)), sketch(own, partition(len(own))))
                for size in sizes:
                    if len(words) >= size:
                        post(key, WHOLE, passing(whole if size == SIZE else shingle_hashes(words, hashes, size), held_small))
            return [np.concatenate(x) for x in (keys, parts, found)] if keys else [[], [], []]

        return work

    return map_blocks(rows, make, "key long, part int, hash long")


def _shingles(words: list[bytes], size: int) -> set:
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keys_only: bool = False) -> DataFrame:
    """Per document and test item contained in it: id, item_id, n_item (shingles), n_shared, containment; or the keys of the
    rows with a hit alone."""
    postings = checkpointed(item_postings(items, item_id, item_text).distinct())
    sizes = [r["words"] for r in postings.where(F.col("n") < SMALL).select("words").distinct().orderBy("words").collect()]  # 1 to SIZE
    rows = id_and_text(docs, id_col, text_col).withColumnRenamed(text_col, "doc_text").where("doc_text is not null")
    rows = rows.withColumn("key", F.xxhash64(id_col, "doc_text"))  # rows that happen to share a key are told apart by verifying
    posted = checkpointed(document_postings(rows.select("key", "doc_text"), _bitmap(postings.where(F.col("n") >= SMALL)), _bitmap(postings.where(F.col("n") < SMALL)), sizes))
    parts = [r["part"] for r in posted.select("part").distinct().orderBy("part").collect() if r["part"] != WHOLE]  # some thirty at most
    asked = checkpointed(item_sketches(items, item_id, item_text, parts, percent).distinct().join(posted.select("part", "hash").distinct().hint("merge"), ["part", "hash"]))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = posted.distinct().withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(asked, ["part", "hash", "salt"])
    counted = met.groupBy("key", "item", "part").agg(F.count("*").alias("equal"), F.min("least").alias("least"))  # items of one id: the least of them
    pairs = checkpointed(counted.where("equal >= least").select("key", "item").distinct())
    named = id_and_text(items, item_id, item_text).toDF("item", "item_text").where("item is not null").distinct()
    texts = narrowed(rows, "key", pairs.select("key")).distinct()
    both = pairs.join(texts, "key").join(named, "item").select("key", F.col(id_col).alias("id"), "item", "doc_text", "item_text")
    out = both.select("key", "id", "item", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets, words = None, {}, []
        for batch in batches:
            got = []
            for at, doc, item, text, test in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != text:
                    held, sets, words = text, {}, word_bytes(text)
                asked = word_bytes(test)
                size = min(SIZE, len(asked))
                if not size:
                    continue
                if size not in sets:
                    sets[size] = _shingles(words, size)
                own = _shingles(asked, size)
                shared = len(own & sets[size])
                if 100 * shared >= percent * len(own):
                    got.append({"key": at, "id": doc, "item": item, "n_item": len(own), "n_shared": shared})
            yield pa.RecordBatch.from_pylist(got, pa.schema([(f, pa.int64()) for f in ("key", "id", "item", "n_item", "n_shared")]))

    hits = both.mapInArrow(run, out)
    if keys_only:
        return hits.select("key").distinct()
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best")
    return hits.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_id)).agg(best).select(id_col, item_id, "best.n_item", "best.n_shared", "best.containment")


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item is contained, with all their columns."""
    hits = checkpointed(find_leaks(docs, items, percent, id_col, text_col, keys_only=True))
    return without(docs, F.xxhash64(quoted(id_col).cast("long"), quoted(text_col).cast("string")), hits)
