"""Document fingerprints: quartile bucket digests.

Byte triplets of a sliding window of four bytes are hashed into 256 buckets and counted. A digest holds each bucket's
place among the quartiles of all counts (two bits), the ratios of the quartiles, and the length on a log scale. Two
digests differ by their buckets (a step of one or two counts so much, the whole range twice the last), their ratios and
lengths; the difference, bounded, gives a likeness from 0 to 1.

A null text counts as empty; empty texts share one digest, and equal texts always have equal ones. Rows follow each
other by descending id, null ids last, rows of one id by the hash of their texts (equal rows stand together); the last is followed by the first, a
lone row by itself. Repeated rows each get a row. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, small_batches

BUCKETS = 256
#: A difference from this on is a likeness of 0: about that of digests drawn at random.
FAR = 420
#: Rows of one run of following documents, and runs that the driver plans at most; beyond that runs are longer.
RUN_ROWS, MOST_RUNS = 8192, 20_000
#: Runs that one id's rows are numbered for at most.
WITHIN = 1 << 20


def _counts(data: np.ndarray) -> np.ndarray:
    n = len(data) - 3
    if n < 1:
        data = np.concatenate([data, np.zeros(1 - n, np.uint32)])  # short texts: as if zero bytes followed
        n = 1
    a, b, c, d = (data[k : k + n] for k in range(4))
    first = a * np.uint32(0x9E3779B1)
    near, far = b * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
    last = d * np.uint32(0x27D4EB2F)
    total = np.zeros(BUCKETS, np.int64)
    for x in (first + near + far, (first + near + last) ^ np.uint32(0x5BD1E995), (first + far + last) ^ np.uint32(0x2545F491)):
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        total += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    """70 bytes in hex: length, two ratios, 64 bytes of bucket quartiles; empty texts have length 0 and no buckets."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "00" * (3 + BUCKETS // 4)
    counts = _counts(data.astype(np.uint32))
    q1, q2, q3 = (int(x) for x in np.partition(counts, (63, 127, 191))[[63, 127, 191]])
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    ratio = lambda x: min(255, 255 * x // max(1, q3))
    return bytes([min(255, 1 + round(12 * math.log(len(data)))), ratio(q1), ratio(q2)]).hex() + packed.astype(np.uint8).tobytes().hex()


_STEPS = np.array([[sum((0, 1, 2, 6)[abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], np.int32)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, down to 0 at a difference of ``FAR`` or more."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (one, other))
    if not a[0] or not b[0]:
        return 0.0
    far = int(_STEPS[a[3:], b[3:]].sum()) + abs(int(a[0]) - int(b[0])) + (abs(int(a[1]) - int(b[1])) + abs(int(a[2]) - int(b[2]))) // 16
    return max(0.0, 1.0 - max(far, 1) / FAR)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_runs(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``run``, ``last`` and ``more``: runs follow each other by descending id, and at the end of each run stands a copy
    (``more``) of the row that follows its last row. An id with more rows than a run holds has runs of its own, by the hashes of its texts.
    Only ids and hashes decide; the driver sees run bounds alone."""
    order = [F.col(id_col).desc_nulls_last(), F.col("mark")]
    rows = rows.withColumn("mark", F.xxhash64("text"))
    n = rows.count()
    runs = max(1, min(MOST_RUNS, -(-n // RUN_ROWS)))
    size = -(-n // runs)
    heavy = rows.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 2 * size).collect()  # fewer than runs
    cuts = []
    if runs > 1:
        found = rows.agg(F.percentile_approx(id_col, [k / runs for k in range(1, runs)], max(10_000, 20 * runs))).first()[0]
        alone = [c for r in heavy if r[id_col] is not None for c in (r[id_col] - 1, r[id_col])]
        cuts = sorted({*(found or []), *alone})
    # Run 0 has the largest ids; rows without an id stand in the last run of all.
    run = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _cuts_below(F.col(id_col), cuts)).cast("long") * WITHIN
    if heavy:
        parts = rows.sparkSession.createDataFrame([(r[id_col], -(-r["n"] // size)) for r in heavy], "heavy long, parts long")
        rows = rows.join(F.broadcast(parts), rows[id_col].eqNullSafe(parts["heavy"]), "left").drop("heavy")
        place = F.floor((F.col("mark") / float(1 << 64) + 0.5) * F.least(F.col("parts"), F.lit(WITHIN)))
        run = run + F.when(F.col("parts").isNull(), 0).otherwise(F.least(place, F.col("parts") - 1, F.lit(WITHIN - 1)))
    rows = rows.withColumn("run", run).drop("parts")
    heads = rows.groupBy("run").agg(F.max_by(F.struct(id_col, "mark"), F.struct(F.col(id_col).isNotNull(), id_col, -F.col("mark").cast("decimal(20,0)"))).alias("head"))
    heads = sorted((r["run"], r["head"][id_col], r["head"]["mark"]) for r in heads.collect())  # one for each run at most
    before = [(heads[k - 1][0], key, mark) for k, (_, key, mark) in enumerate(heads)]  # the first row follows the last run
    ends = rows.sparkSession.createDataFrame(before, "to long, head_id long, head_mark long")
    copies = rows.join(F.broadcast(ends), rows[id_col].eqNullSafe(ends["head_id"]) & (rows["mark"] == ends["head_mark"])).select(id_col, "text", "mark", F.col("to").alias("run"), F.lit(True).alias("more")).dropDuplicates([id_col, "mark", "run"])
    whole = rows.select(id_col, "text", "mark", "run", F.lit(False).alias("more")).unionByName(copies)
    # Each run goes to a partition of its own: by a number that Spark's hash sends there.
    parts = max(1, len(heads))
    tried = rows.sparkSession.range(16 * parts + 64)
    keys = {r["p"]: r["id"] for r in tried.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()}
    at = rows.sparkSession.createDataFrame([(run, keys.get(k, k)) for k, (run, *_) in enumerate(heads)], "run long, at long")
    return whole.join(F.broadcast(at), "run").repartition(parts, "at").sortWithinPartitions("run", "more", *order).drop("at")


def _cuts_below(col: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are smaller than the id: first among every k-th, then in one group of k."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    groups = [cuts[at : at + k] for at in range(0, len(cuts), k)]
    below = lambda some: F.size(F.filter(some, lambda c: c < col))
    group = below(F.array(*(F.lit(g[0]) for g in groups[1:])).cast("array<long>"))
    return group * k + below(F.get(F.array(*(F.array(*map(F.lit, g)).cast("array<long>") for g in groups)), group))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, SHA-256 of the edited text, both digests, and the likeness of the row's digest to that of its edited
    text and of the row that follows."""
    rows = id_and_text(docs, id_col, text_col).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    out = docs.sparkSession.createDataFrame([], f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = []
                part = batch.slice(at, 512)
                for key, text, of, more in zip(*(part.column(c).to_pylist() for c in (id_col, "text", "run", "more")), strict=True):
                    own = digest(text)
                    if held is not None and held[2] == of:
                        was, before, _, print_ = held
                        new = edited(before, text)
                        changed = digest(new)
                        got.append((was, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, own)))
                    held = None if more else (key, text, of, own)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)

    return small_batches(in_runs(rows, id_col)).mapInArrow(run, out)
