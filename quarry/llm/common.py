"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.spec import quoted
from quarry.sources.shared import written

#: Rows of one Arrow batch that are worked on together; bounds a worker's memory.
BLOCK = 256


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, so that no other column can clash with what it adds."""
    return df.select(quoted(id_col).cast("long").alias(id_col), quoted(text_col).cast("string").alias(text_col))


#: Bytes of an Arrow batch, unless the session sets them: texts are long, and each task holds some batches on both sides,
#: outside the heap too.
BATCH_BYTES = "2m"
#: Bytes of batches after which a worker gives free memory back.
GIVE_BACK = 8 << 20


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table. They are sent as Arrow: Spark turns rows of Python objects into its own in
    Python workers beside those of the operators, which stay in the executors' memory for a while."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = spark.createDataFrame([], schema).schema
    fields = to_arrow_schema(kinds)
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), kinds)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are bounded in bytes from now on, if it hasn't bounded them itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def give_back() -> None:
    """Free memory goes back to the machine. Workers outlive their tasks, and what they keep is taken from an executor's other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_parts(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs whose sizes sum to ``most`` at most, or of one each that is larger."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_blocks(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str, block: int = BLOCK) -> DataFrame:
    """Run ``make()(columns)`` over blocks of rows; columns come and go as Python lists or arrays.

    ``make`` runs once a task, on the executor. The returned columns follow ``schema`` and may hold any number of rows.
    """
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        work, seen = make(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                got = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, kinds, strict=True)], schema=kinds)
            got = part = None
            seen += batch.nbytes
            if seen >= GIVE_BACK:
                seen = 0
                give_back()
        work = None  # with all that it remembers
        give_back()

    return small_batches(df).mapInArrow(run, out)


def fold_of(id_col: str, folds: int) -> Column:
    """The remainder of the crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def word_bytes(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound in bytes."""

    #: What an entry takes beside its word: the objects' heads, the number and the place in the table.
    ENTRY = 180

    def __init__(self, most_bytes: int = 24 << 20):
        import xxhash

        self.most, self.held, self.hash = most_bytes, 0, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) <= 64:
            self.held += self.ENTRY + len(word)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = value
        return value


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words count whole as one, no words as none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < size:
        size = n
    with np.errstate(over="ignore"):
        got = mix(h[: n - size + 1])
        for k in range(1, size):
            got = mix(got ^ h[k : n - size + 1 + k])
        got = mix(got + np.uint64(size))
    return np.unique(got)


#: Words whose shingles are worked out together.
WORDS_TOGETHER = 30_000


def shingle_sets(texts: Sequence[str | None], size: int = 5) -> list[np.ndarray]:
    """``shingle_hashes`` of the words of each text, worked out for many texts together. Words are hashed anew each time: where they vary, that
    takes less time than to look them up."""
    import xxhash

    words = [word_bytes(t) for t in texts]
    sets: list[np.ndarray] = []
    for low, high in in_parts([len(w) for w in words], WORDS_TOGETHER):
        some = words[low:high]
        counts = [len(w) for w in some]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(some)), np.uint64, sum(counts))
        if len(h) >= size:  # shingles that reach across texts are left out below
            got = mix(h[: len(h) - size + 1])
            for k in range(1, size):
                got = mix(got ^ h[k : len(h) - size + 1 + k])
            with np.errstate(over="ignore"):
                got = mix(got + np.uint64(size))
        at = 0
        for w, n in zip(some, counts, strict=True):
            if n < size:
                sets.append(shingle_hashes(w, WordHashes(0), size))
            else:
                own = np.sort(got[at : at + n - size + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            at += n
    return sets


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder, read from there from now on."""
    return written(df)


#: Bits of the bitmap that narrows a table to wanted ids; bounds what is broadcast to 2**16 rows.
BITMAP_BITS = 22


def flagged(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """With ``_maybe``: whether the key may be among ``wanted``'s single column, by a bitmap of fixed size over hashed keys."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    word = lambda c: F.shiftright(place(c), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    listed = F.col(wanted.columns[0])
    words = wanted.groupBy(word(listed).alias("_word")).agg(F.bit_or(bit(listed)).alias("_bits"))
    found = df.withColumn("_word", word(key)).join(F.broadcast(words), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def narrowed(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id may be among ``wanted``'s single column, so that the rows that a join would drop are mostly
    not shuffled. Some others pass; an exact join follows."""
    return flagged(df, F.col(id_col), wanted).where("_maybe").drop("_maybe")


def as_one(df: DataFrame) -> Column:
    """The caller's whole row as one struct, so that no column of an operator's own can clash with it."""
    return F.struct(*map(quoted, df.columns)).alias("row")


def as_given(held: DataFrame, like: DataFrame) -> DataFrame:
    """The caller's rows out of the structs ``row``."""
    return held.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def without(df: DataFrame, key: Column, unwanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key isn't among ``unwanted``'s single column. Only rows that may be are shuffled to be joined exactly."""
    rows = flagged(df.select(as_one(df), key.alias("key")), F.col("key"), unwanted)
    tried = rows.where("_maybe").join(unwanted.toDF("key").distinct(), "key", "left_anti").select("row")
    return as_given(rows.where("not _maybe").select("row").unionByName(tried), df)
