"""How quality filters interact: what each removes in every order, from sorted posting lists.

Each document gets a running number. For each part and each range of ``RANGE`` numbers, a filter has the sorted list of the
numbers that fail it, and so have the two kinds of labels. A range's unions of filters are merged from these lists
by galloping: the list that is behind leaps ahead in steps that double, so runs cost little more than their ends. What
a filter removes after any set of others is the difference of its list and their union, found alike. Only sizes leave a range;
sums over the ranges of a part give the counts of all orders, so no part, however large, meets in one task.

Null texts are empty. ``A`` short, ``B`` repetitive, ``C`` capitals, ``D`` marks, ``E`` copies of a smaller id's text. A document without
an id neither is nor has a copy; rows that share an id are documents of their own and no copies of one another. A null part is
empty. A document is good or toxic if any row of the labels with its id says so; null ids have no labels. An
empty table has no parts. Other columns aren't read; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, map_blocks

FILTERS = "ABCDE"
#: Documents of a range: the longest list that a task holds.
RANGE_BITS = 16
#: Parts that the rows of one text are dealt into where they meet its smallest id.
SALTS = 16
#: Bits of a document's failures, then good, then toxic.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)

_marks = re.compile(r"[#$%&*|]").search
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str | None) -> int:
    """Bits of the filters A to D that the text fails."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, capitals = len(words), len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (n < 50, 100 * len(set(words)) < 65 * n, 100 * capitals > 5 * len(text), _marks(text) is not None)
    return sum(1 << k for k, f in enumerate(fails) if f)


def leap(numbers: Sequence[int], x: int, at: int) -> int:
    """The first place from ``at`` on whose number isn't below ``x``, by steps that double."""
    n, step = len(numbers), 1
    while at + step < n and numbers[at + step] < x:
        at, step = at + step, step * 2
    return bisect_left(numbers, x, at, min(at + step + 1, n))


def merged(lists: Sequence[Sequence[int]]) -> list[int]:
    """The sorted union of sorted lists without repeats; runs of one list are taken whole."""
    out: list[int] = []
    heads = [[x[0], k, 0] for k, x in enumerate(lists) if x]
    while heads:
        if len(heads) == 1:
            _, k, at = heads[0]
            out.extend(lists[k][at:])
            break
        heads.sort()
        first, k, at = heads[0]
        second = heads[1][0]
        own = lists[k]
        if first == second:  # the others keep it
            to = at + 1
        else:
            to = leap(own, second, at)
            out.extend(own[at:to])
        if to < len(own):
            heads[0][0], heads[0][2] = own[to], to
        else:
            del heads[0]
    return out


def without(numbers: Sequence[int], others: Sequence[int]) -> list[int]:
    """The sorted difference; both lists leap over what the other lacks."""
    out: list[int] = []
    i = j = 0
    while i < len(numbers):
        if j == len(others):
            out.extend(numbers[i:])
            break
        if numbers[i] < others[j]:
            to = leap(numbers, others[j], i)
            out.extend(numbers[i:to])
            i = to
        elif numbers[i] > others[j]:
            j = leap(others, numbers[i], j)
        else:
            i, j = i + 1, j + 1
    return out


def shared(numbers: Sequence[int], others: Sequence[int]) -> int:
    """The size of the intersection."""
    n = i = j = 0
    while i < len(numbers) and j < len(others):
        if numbers[i] < others[j]:
            i = leap(numbers, others[j], i)
        elif numbers[i] > others[j]:
            j = leap(others, numbers[i], j)
        else:
            n, i, j = n + 1, i + 1, j + 1
    return n


def sizes(failing: Sequence[Sequence[int]], good: Sequence[int], toxic: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(filters before as bits, filter, removed, of these good, of these toxic) for every set of filters before; nothing where none is removed."""
    k = len(failing)
    for before in range(1 << k):
        union = merged([failing[i] for i in range(k) if before >> i & 1])
        for i in range(k):
            if not before >> i & 1 and failing[i]:
                removed = without(failing[i], union)
                if removed:
                    yield before, i, len(removed), shared(removed, good), shared(removed, toxic)


def checked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, number, fails, h1, h2): failures of each row, and the 128-bit name of its text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("number"), F.col(text_col).cast("string").alias("text"))

    def make():
        half = lambda x: x - (1 << 64) if x >> 63 else x

        def work(columns):
            ids, parts, numbers, texts = columns
            names = [xxhash.xxh3_128_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            return [ids, parts, numbers, [failures(t) for t in texts], [half(x >> 64) for x in names], [half(x & (1 << 64) - 1) for x in names]]

        return work

    return map_blocks(rows, make, "id long, part string, number long, fails int, h1 long, h2 long")


def postings(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, range_bits: int) -> DataFrame:
    """(part, range, docs, a list of failing numbers per filter, good, toxic), lists sorted; a range has 2 ** range_bits numbers at most."""
    table = checkpointed(checked(docs, id_col, text_col, part_col))
    first = table.where("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = first.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a text may stand on any share of the rows
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        (F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) * GOOD + F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)) * TOXIC).alias("said")
    )
    copy = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    bits = F.col("fails").bitwiseOR(copy).bitwiseOR(F.coalesce("said", F.lit(0)))
    rows = table.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int")).join(first, ["h1", "h2", "salt"], "left").join(said, "id", "left").select("part", F.shiftright("number", range_bits).alias("range"), "number", bits.alias("bits"))
    listed = [F.sort_array(F.collect_list(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("number")))).alias(f"l{k}") for k, bit in enumerate([1 << i for i in range(len(FILTERS))] + [GOOD, TOXIC])]
    return rows.groupBy("part", "range").agg(F.count("*").alias("docs"), *listed)


def _sizes_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()), *((c, pa.int64()) for c in ("removed", "good_lost", "toxic_lost"))])
    lists = [f"l{k}" for k in range(len(FILTERS) + 2)]
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            *failing, good, toxic = (one.column(c)[0].as_py() for c in lists)
            got = list(sizes(failing, good, toxic))
            part = one.column("part")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.string()), *(pa.array([r[c] for r in got], schema.field(c + 1).type) for c in range(5))], schema=schema)


def orders() -> list[tuple[str, list[int]]]:
    """Each order with the filters before each step as bits."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = [sum(1 << i for i in order[:k]) for k in range(len(order))]
        out.append(("".join(FILTERS[i] for i in order), before))
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", range_bits: int = RANGE_BITS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    held = checkpointed(postings(docs, labels, id_col, text_col, part_col, range_bits))
    k = len(FILTERS)
    summed = held.select("part", *(f"l{i}" for i in range(k + 2))).mapInArrow(_sizes_of_ranges, "part string, before int, filter int, removed long, good_lost long, toxic_lost long")
    summed = summed.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    # An order puts the filters of ``before`` first in |before|! ways and those after in the rest's.
    ways = F.array(*(F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k)))
    weight = F.element_at(ways, F.bit_count("before").cast("int") + 1)
    key = F.col("filter") * (1 << k) + F.col("before")
    by_part = summed.groupBy("part").agg(  # 80 rows a part
        F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.struct("removed", "good_lost", "toxic_lost").alias("n")))).alias("n"),
        *(F.coalesce(F.sum(F.when(F.col("filter") == i, F.col("removed") * weight)), F.lit(0)).alias(f"s{i}") for i in range(k)),
    )
    parts = held.groupBy("part").agg(F.sum("docs").alias("docs")).join(by_part, "part", "left")

    of = lambda filter_, before: F.col("n")[filter_ * (1 << k) + before]
    none = F.lit(0).cast("long")
    size = lambda filter_, before, what="removed": F.coalesce(of(filter_, before)[what], none)
    listed = orders()
    places = F.array(*(F.lit(FILTERS.index(c)) for order, _ in listed for c in order))
    masks = F.array(*(F.lit(b) for _, before in listed for b in before))
    rows = parts.select("part", "docs", "n", F.array(*(F.coalesce(F.col(f"s{i}"), none) for i in range(k))).alias("shapley"), F.explode(F.sequence(F.lit(0), F.lit(len(listed) - 1))).alias("o"))
    rows = rows.select("*", F.posexplode(F.slice(places, F.col("o") * k + 1, F.lit(k))).alias("at", "filter"), F.element_at(F.array(*(F.lit(order) for order, _ in listed)), F.col("o") + 1).alias("filter_order"))
    before = F.element_at(masks, F.col("o") * k + F.col("at") + 1)
    rows = rows.withColumn("before", before)
    gone = F.aggregate(F.sequence(F.lit(0), F.col("at")), none, lambda total, j: total + size(F.element_at(places, F.col("o") * k + j + 1), F.element_at(masks, F.col("o") * k + j + 1)))
    others = F.lit((1 << k) - 1) - F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.col("filter") + 1)
    removed = size(F.col("filter"), F.col("before"))
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), (F.col("docs") - gone).alias("kept"), removed.alias("removed"), (size(F.col("filter"), F.lit(0)) - removed).alias("redundant"), size(F.col("filter"), others).alias("unique_fails"),
        size(F.col("filter"), F.col("before"), "good_lost").alias("good_lost"), size(F.col("filter"), F.col("before"), "toxic_lost").alias("toxic_lost"), F.element_at("shapley", F.col("filter") + 1).alias("shapley"),
    )


def oracle() -> str:
    return r"""
    with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    firsts as (select t, min(doc_id) as first from d group by t),
    marked as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels where doc_id is not null group by doc_id),
    worded as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
    judged as (
      select part, coalesce(good, 0) as good, coalesce(m.toxic, 0) as toxic,
        (len(ws) < 50)::int as a, (100 * len(list_distinct(ws)) < 65 * len(ws))::int as b, (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t))::int as c,
        regexp_matches(t, '[#$%&*|]')::int as d, coalesce(w.doc_id > first, false)::int as e
      from worded w join firsts using (t) left join marked m on m.doc_id = w.doc_id),
    masks as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all),
    letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
    orders as (
      select v.f || w.f || x.f || y.f || z.f as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits from letter v, letter w, letter x, letter y, letter z
      where v.bit | w.bit | x.bit | y.bit | z.bit = 31),
    steps as (select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as before from orders, range(1, 6) as r(s)),
    counted as (
      select part, filter_order, step, bit,
        sum(case when fails & (before | bit) = 0 then n else 0 end)::bigint as kept,
        sum(case when fails & bit <> 0 and fails & before = 0 then n else 0 end)::bigint as removed,
        sum(case when fails & bit <> 0 and fails & before <> 0 then n else 0 end)::bigint as redundant,
        sum(case when fails = bit then n else 0 end)::bigint as unique_fails,
        sum(case when fails & bit <> 0 and fails & before = 0 then good else 0 end)::bigint as good_lost,
        sum(case when fails & bit <> 0 and fails & before = 0 then toxic else 0 end)::bigint as toxic_lost
      from masks, steps group by all)
    select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley from counted"""
