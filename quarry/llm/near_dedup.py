"""Near-duplicate groups by SetSketch registers.

A text's set holds its distinct shingles of five words (all words as one if there are fewer). Each shingle sends out a
Poisson process of points to registers drawn at random; a register keeps the least of all points that reach it, on an
exponentially spaced scale. Registers are mergeable (the greater value wins) and agree between two sets about as often
as their Jaccard similarity. Bands of four registers are buckets.

1. Equal sets are one class, named by its least id. Only classes go on.
2. Each class is paired with the hub (the first class of a bucket) that it shares most buckets with, and links are
   confirmed on full sets. Connected classes form components.
3. Where buckets still hold several components, new hubs are drawn; each class is paired with the hub of
   another component that the joint maximum-likelihood estimate from registers and sizes finds most similar.
4. Of each bucket that still holds several components, the classes outside its main one are dealt into blocks, those of
   one main component together. All classes of their buckets stream past the blocks, and pairs across components whose
   registers allow a link are confirmed.

So every pair that shares a bucket is either confirmed, excluded, or in one component already: components are those of
all links, though copies are never expanded into all pairs. A link at the very threshold shares no bucket with
probability 0.684 ** 32, about 5 in a million; the estimate has a standard error of 0.035 there, so one in 100,000 is
refused by it or by the count of equal registers. Both fall quickly above the threshold, and links between copies have other ways round.

Null or empty texts and those of white space have the empty set and link with nothing. Rows that share an id, repeated
or with different texts, are one document that links by any of its texts; each gets a row. Rows without an id link
with nothing, have no component and are kept. Other columns aren't read; where whole rows are returned, they are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_given, as_one, checkpointed, give_back, id_and_text, in_parts, map_blocks, mix, narrowed, shingle_sets, small_batches, without
from quarry.plans.spec import quoted

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, SHIFT = 1.001, 8000
#: A pair's estimate may be so far below the threshold: above four standard errors.
SLACK = 0.15
#: Rounds of new hubs, hubs whose sets a task holds, and members that meet one copy of them.
HUB_ROUNDS, HELD, MEMBERS = 1, 512, 2000
#: Hubs from which on a member is held against them by the numbers of their hashes.
ASKED = 8
#: Classes whose registers, 256 bytes each, a task holds, members that meet them together, pairs that are looked at together, and pairs that are listed together.
HELD_REGISTERS, MEET, PAIRS, MOST_FOUND = 2048, 512, 65_536, 1_000_000
#: Shingles that are sketched together, their points that are drawn together, and those of one shingle.
TOGETHER, POINTS, MOST_POINTS = 50_000, 8192, 64
#: Nodes that a task holds while it replaces links by stars, and edges for which there is a task.
MOST_NODES, EDGES = 200_000, 50_000


def _points(h: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, register, value) of the points below each element's limit; the process of an element depends on its hash alone."""
    who, where, what = [], [], []
    element, value, j = np.arange(len(h)), np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(element):
            more = max(1, min(MOST_POINTS, POINTS // len(element)))  # the few elements of small sets have many points each
            x = mix(h[element][:, None] + np.arange(j + 1, j + more + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
            gaps = np.log(((x >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0) / most
            gaps[:, 0] = value - gaps[:, 0]
            values = np.subtract.accumulate(gaps, axis=1)
            stays = values < limit[element][:, None]
            who.append(np.repeat(element, stays.sum(1)))
            where.append((mix(x[stays]) % np.uint64(most)).astype(np.int64))
            what.append(values[stays])
            on = stays[:, -1]
            element, value, j = element[on], values[on, -1], j + more
    return np.concatenate(who), np.concatenate(where), np.concatenate(what)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (set, register) of sets of hashes, none of them empty."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.inf)
    todo, reach = np.arange(len(sets)), math.log(REGISTERS) + 4
    while len(todo):  # a register that no point has reached yet: look further
        doc = np.repeat(todo, sizes[todo])
        who, where, what = _points(np.concatenate([sets[k] for k in todo]), (reach / sizes)[doc], REGISTERS)
        np.minimum.at(least.reshape(-1), doc[who] * REGISTERS + where, what)
        todo = np.flatnonzero(np.isinf(least).any(1))
        reach *= 2
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)) + SHIFT, 0, 65535).astype(np.uint16)


def estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from which register is greater how often and from the known sizes."""
    above, below = (one > other).sum(1), (one < other).sum(1)
    equal = one.shape[1] - above - below
    u = n_one / (n_one + n_other)
    v = 1 - u
    p = lambda x: np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the log-likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, bands): size, 128-bit name and packed registers of each row's set."""

    def make():
        def work(columns):
            ids, texts = columns
            sets = shingle_sets(texts)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            for low, high in in_parts([len(sets[k]) for k in full], TOGETHER):
                packed = sketches([sets[k] for k in full[low:high]]).view(np.int64)
                for k, row in zip(full[low:high], packed, strict=True):
                    bands[k] = row
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda x: x - (1 << 64) if x >> 63 else x
            return [ids, [len(s) for s in sets], [half(x >> 64) for x in names], [half(x & (1 << 64) - 1) for x in names], bands]

        return work

    return map_blocks(id_and_text(docs, id_col, text_col), make, f"{id_col} long, n long, h1 long, h2 long, bands array<long>")


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n_u, n_v, bands_u, bands_v and more) whose estimate isn't far below the threshold; registers go, ``guess`` comes."""
    kept = [c for c in pairs.columns if c not in ("bands_u", "bands_v")]
    out = pairs.select(*kept, F.lit(0.0).alias("guess")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.asarray(batch.column(c).flatten()).view(np.uint16).reshape(-1, REGISTERS) for c in ("bands_u", "bands_v"))
                guess = estimate(u, v, *(np.asarray(batch.column(c)).astype(float) for c in ("n_u", "n_v")))
                got = batch.select(kept).append_column("guess", pa.array(guess))
                yield got.filter(pa.array(guess >= percent / 100 - SLACK))

    return pairs.mapInArrow(run, out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes have that Jaccard similarity; an empty set is similar to none."""
    if not len(a) or not len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity."""
    pairs = pairs.select("u", "v").distinct()
    blocks = max(1, -(-pairs.select("v").distinct().count() // HELD))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)))
    members = dealt.groupBy("block", F.col("u").alias("id")).agg(F.collect_list("v").alias("hubs"))  # of one block, so some hundred
    members = members.unionByName(dealt.select("block", F.col("v").alias("id"), F.lit(None).cast("array<long>").alias("hubs")))
    return _meet(members, docs, percent, id_col, text_col)


def confirm_rest(mixed: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The links (u, v) across components among classes that share a bucket. The classes outside their bucket's main component
    are dealt into blocks with those of the same main component, so that what shares buckets meets in few blocks; the registers of every class
    of a bucket go to the blocks that have one of its bucket, and meet those that they share a bucket with there. Only texts that may have a link
    move, to the parts of blocks that hold what they may link with: rows grow with classes, not with the pairs that look alike."""
    rows = _labelled(mixed, labels)
    main = rows.groupBy("bucket", "label").count().groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("bucket", "main")
    rows = checkpointed(rows.join(main, "bucket"))
    outside = rows.where("label <> main")
    placed = checkpointed(_placed(outside))
    outside = outside.select("rep", "bucket").join(placed.select("rep", "block"), "rep")
    members = rows.select("bucket", "rep", "label").join(outside.select("bucket", "block").distinct(), "bucket").select("block", "rep", "label").distinct()
    copies = members.groupBy("block").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    members = members.join(copies, "block").select("block", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("member"), "rep", "label", F.lit(0).cast("long").alias("part"))
    held = placed.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("member"), "rep", "label", "part")
    met = members.unionByName(held).join(classes.select("rep", "n", "bands"), "rep").repartition("block", "salt").sortWithinPartitions("block", "salt", "member")
    out = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("hubs", pa.list_(pa.int64()))])

    def listed(pairs: list[tuple[int, int]], part: dict[int, int]) -> pa.RecordBatch:
        """(member, hub) as rows: each member with its hubs of a part, and each hub by itself."""
        got = [{"block": part[v], "id": v, "hubs": None} for v in {v for _, v in pairs}]
        of: dict[tuple[int, int], list[int]] = {}
        for u, v in pairs:
            of.setdefault((part[v], u), []).append(v)
        return pa.RecordBatch.from_pylist(got + [{"block": k, "id": u, "hubs": hubs} for (k, u), hubs in of.items()], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, part = None, [], None, {}
        for batch in batches:
            names = [np.asarray(batch.column(c)) for c in ("block", "salt", "member", "rep", "label", "n")]
            bands = np.asarray(batch.column("bands").flatten()).reshape(-1, BANDS)
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in names[:3]], axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                block, salt, member = (c[low] for c in names[:3])
                some = [c[low:high] for c in (*names[3:], bands)]
                if at != (block, salt):
                    at, parts, held, part = (block, salt), [], None, {}
                if not member:
                    parts.append(some)
                    part.update(zip(some[0].tolist(), batch.column("part").slice(low, high - low).to_pylist(), strict=True))
                    continue
                if held is None:
                    held = Held(*(np.concatenate(x) for x in zip(*parts, strict=True)), percent=percent)
                for k in range(0, high - low, MEET):
                    found: list[tuple[int, int]] = []  # a member's hubs of all bands go in one row
                    for more in held.meet(*(c[k : k + MEET] for c in some)):
                        found += more
                        if len(found) > MOST_FOUND:
                            yield listed(found, part)
                            found = []
                    if found:
                        yield listed(found, part)

    return _meet(met.mapInArrow(run, "block long, id long, hubs array<long>"), docs, percent, id_col, text_col)


def _placed(outside: DataFrame) -> DataFrame:
    """(rep, label, block, part): each class that is outside the main component of buckets (rep, label, main), with the block and the part of it where it is held.
    A class goes with the main component that it shares most buckets with. The classes of a main component are one group, or some where a block or part
    can't hold them all; a block holds some groups, and each part belongs to one block."""
    homes = outside.groupBy("rep", "label").agg(F.mode("main", deterministic=True).alias("home"))
    blocks = 1 + outside.agg(F.approx_count_distinct("rep").alias("n")).first()["n"] // HELD_REGISTERS
    sizes = homes.groupBy("home").count()
    group = lambda most: F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / most))
    block = F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(blocks)), group(HELD_REGISTERS))
    part = F.xxhash64("block", F.pmod(F.xxhash64("home", F.lit(1)), F.lit(-(-HELD_REGISTERS // HELD))), group(HELD))
    return homes.join(sizes, "home").withColumn("block", block).select("rep", "label", "block", part.alias("part"))


class Held:
    """Classes of a block, found by their bands: only those that share a bucket with a member are looked at."""

    def __init__(self, reps: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bands: np.ndarray, percent: int):
        self.reps, self.labels, self.sizes, self.bands = reps, labels, sizes, bands
        self.percent, self.least = percent, _least_equal(percent)
        self.order = np.argsort(bands, axis=0, kind="stable")
        self.sorted = np.take_along_axis(bands, self.order, axis=0)

    def meet(self, reps: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bands: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """(member, held) pairs of different components that share a bucket and whose sizes and registers allow a link, each in the first band that they share."""
        for band in range(BANDS):
            low, high = (np.searchsorted(self.sorted[:, band], bands[:, band], side) for side in ("left", "right"))
            ends = np.cumsum(high - low)
            for first in range(0, int(ends[-1]), PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
                member = np.searchsorted(ends, pair, "right")
                held = self.order[low[member] + pair - (ends[member] - (high - low)[member]), band]
                mine, theirs = sizes[member], self.sizes[held]
                other = (labels[member] != self.labels[held]) & (100 * np.minimum(mine, theirs) >= self.percent * np.maximum(mine, theirs))
                member, held = member[other], held[other]
                if band:
                    new = ~(bands[member, :band] == self.bands[held, :band]).any(1)
                    member, held = member[new], held[new]
                if not len(member):
                    continue
                mine, theirs = bands[member].view(np.uint16), self.bands[held].view(np.uint16)
                near = (mine == theirs).sum(1) >= self.least
                if near.any():
                    yield list(zip(reps[member[near]].tolist(), self.reps[held[near]].tolist(), strict=True))


def _meet(members: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The links (u, v) between members (block, id, hubs) and their hubs, which have rows without hubs. A task holds the sets of a block's hubs, some hundred, past
    which the texts of its members stream; where many members meet one block, its hubs are repeated."""
    rows = checkpointed(members)
    members = rows.where("hubs is not null")
    copies = members.groupBy("block").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    hubs = rows.where("hubs is null").select("block", "id").distinct().join(copies, "block")
    hubs = hubs.select("id", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("member"), F.array().cast("array<long>").alias("hubs"))
    streamed = members.join(copies, "block").select("id", "block", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("member"), "hubs")
    asked = streamed.unionByName(hubs)
    texts = narrowed(id_and_text(docs, id_col, text_col).where(f"{id_col} is not null").toDF("id", "text"), "id", asked.select("id"))
    met = asked.join(texts, "id").repartition("block", "salt").sortWithinPartitions("block", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, HubSets(percent)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                got = []
                *some, texts = (batch.column(c).slice(k, 512).to_pylist() for c in ("block", "salt", "member", "id", "hubs", "text"))
                for block, salt, member, key, wanted, own in zip(*some, shingle_sets(texts), strict=True):
                    if at != (block, salt):
                        at, sets = (block, salt), HubSets(percent)
                    if member:
                        got += [(key, v) for v in sets.similar_to(own, wanted)]
                    else:
                        sets.add(key, own)
                yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in got], pa.schema([("u", pa.int64()), ("v", pa.int64())]))
            give_back()
        sets = None
        give_back()

    return checkpointed(small_batches(met).mapInArrow(run, "u long, v long"))


class HubSets:
    """The sets of a block's hubs, all added before the first member comes; a hub has several sets if its id stands on several texts."""

    def __init__(self, percent: int):
        self.percent, self.sets = percent, {}
        self.known: np.ndarray | None = None

    def add(self, hub: int, own: np.ndarray) -> None:
        self.sets.setdefault(hub, []).append(own)

    def similar_to(self, own: np.ndarray, wanted: list[int]) -> list[int]:
        """The wanted hubs that have a set similar to this one."""
        if self.known is None and len(wanted) < ASKED:
            return [v for v in wanted if any(similar(own, x, self.percent) for x in self.sets.get(v, ()))]
        if self.known is None:
            self._number()
        hubs, sets = zip(*([(v, x) for v in wanted for x in self.sets.get(v, ()) if len(x)] or [(None, None)]), strict=True)
        if not len(own) or sets[0] is None:
            return []
        places = np.searchsorted(self.known, own)
        places[places == len(self.known)] = 0
        places = places[self.known[places] == own]
        sizes = np.array([len(x) for x in sets])
        self.mark[places] = 1
        both = np.add.reduceat(self.mark[np.concatenate(sets)], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[places] = 0
        near = 100 * both >= self.percent * (len(own) + sizes - both)
        return list(dict.fromkeys(v for v, yes in zip(hubs, near.tolist(), strict=True) if yes))

    def _number(self) -> None:
        """From now on a set holds its hashes' numbers among those of all sets: a member's are marked, and the marks of each hub counted."""
        self.known = np.unique(np.concatenate([x for own in self.sets.values() for x in own] or [np.empty(0, np.uint64)]))
        self.mark = np.zeros(len(self.known), np.uint8)
        for own in self.sets.values():
            own[:] = [np.searchsorted(self.known, x).astype(np.int32) for x in own]


def stars(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) that join the same nodes: each task replaces what it has read by stars around the least nodes, some hundred thousand nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            path = []
            while (up := parent.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                parent[y] = x
            return x

        def star() -> pa.RecordBatch:
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > MOST_NODES:
                yield star()
        yield star()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to its label, and no label has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(0).alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("label")))
    nodes = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.max("label").alias("label"))
    return nodes.agg(F.bool_and(F.col("a").isNull() | ((F.col("a") == F.col("b")) & (F.col("label") == 0))).alias("all")).first()["all"] is not False


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(node, label): every node of the edges (u, v) with the least node that it reaches, by alternating large and small stars.
    Edges whose number is given are written rows; they and the labels go to as many tasks as they need. Others, which may still have to be found, are read once by the tasks that find them."""
    # Nodes that are their own label come back as those of the edges.
    known = n is not None
    in_tasks = lambda df, most: df.coalesce(1 + most // EDGES) if known else df  # noqa: E731  few edges don't need Python tasks for every partition of a shuffle
    edges = checkpointed(stars(in_tasks(edges, n)))
    while not _are_stars(edges):
        n = edges.count() if known else None
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpointed(stars(in_tasks(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v"), 2 * n if known else None)))
    n, edges = edges.count() if known else None, edges.distinct()
    roots = edges.select("v").distinct()
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
    return checkpointed(in_tasks(labels, n)) if known else labels


def _buckets(classes: DataFrame) -> DataFrame:
    """(rep, bucket): a class in each of its buckets."""
    return classes.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket"))


def _labelled(rows: DataFrame, labels: DataFrame, rep: str = "rep", label: str = "label") -> DataFrame:
    """With the component of each class, its own id if it is in none."""
    return rows.join(labels.toDF(rep, label), rep, "left").withColumn(label, F.coalesce(label, rep))


def _weighed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that may be links by size and estimate, with ``guess``."""
    of = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    met = pairs.join(of("u"), "u").join(of("v"), "v").where(sizes_allow(F.col("n_u"), F.col("n_v"), percent) & registers_agree(percent))
    return likely(met, percent)


def _round_of_hubs(mixed: DataFrame, labels: DataFrame, classes: DataFrame, salt: int, percent: int) -> DataFrame:
    """(u, v): each class of the mixed buckets with the likeliest hub of another component, hubs drawn by hash."""
    rows = _labelled(mixed, labels)
    hubs = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(salt)).alias("draw"), "rep", "label")).alias("hub")).select("bucket", F.col("hub.rep").alias("v"), F.col("hub.label").alias("label_v"))
    pairs = rows.join(hubs, "bucket").where("label <> label_v").select(F.col("rep").alias("u"), "v").distinct()
    return _weighed(pairs, classes, percent).groupBy("u").agg(F.max(F.struct("guess", "v")).alias("best")).select("u", "best.v")


def near_groups(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable over links of ``percent`` similarity) and kept."""
    table = checkpointed(sketch_table(docs, id_col, text_col))
    whole = table.where(f"n > 0 and {id_col} is not null")
    classes = checkpointed(whole.groupBy("h1", "h2").agg(F.min(id_col).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    members = _buckets(classes)
    hubs = members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("bucket", "hub")
    several = checkpointed(members.join(hubs, "bucket"))
    shared = several.where("rep <> hub").groupBy("rep", "hub").count()
    first = shared.groupBy("rep").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("best")).select(F.col("rep").alias("u"), (-F.col("best.hub")).alias("v"))
    first = checkpointed(_weighed(first, classes, percent).select("u", "v"))
    links = confirm(first, docs, percent, id_col, text_col)
    labels = components(links, links.count())

    # Only buckets with several components go on.
    named = _labelled(several.select("rep", "bucket"), labels)
    open_ = named.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    mixed = checkpointed(several.select("rep", "bucket").join(open_, "bucket"))
    involved = checkpointed(classes.join(mixed.select("rep").distinct(), "rep").select("rep", "n", "bands"))
    for salt in range(HUB_ROUNDS):
        tried = checkpointed(_round_of_hubs(mixed, labels, involved, salt, percent))
        if tried.isEmpty():
            break
        labels, more = _joined(labels, confirm(tried, docs, percent, id_col, text_col))
        if not more:
            break
    labels, _ = _joined(labels, confirm_rest(mixed, labels, involved, docs, percent, id_col, text_col))
    labels, _ = _joined(labels, checkpointed(_of_one_id(whole, classes, id_col)))

    named = _labelled(classes.select("h1", "h2", "rep"), labels).select("h1", "h2", "label")
    rows = table.select(id_col, "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col(id_col).isNotNull(), F.col("label")).otherwise(F.col(id_col))
    return rows.select(id_col, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def _of_one_id(whole: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """The links (u, v) between the classes of an id that stands on different texts."""
    own = F.struct("h1", "h2")
    several = whole.groupBy(id_col).agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select(id_col)
    reps = whole.select(id_col, "h1", "h2").join(several, id_col).join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(id_col, "rep")
    least = reps.groupBy(id_col).agg(F.min("rep").alias("v"))
    return reps.join(least, id_col).where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()


def registers_agree(percent: int) -> Column:
    """Whether about as many registers are equal as a link needs, less the slack."""
    equal = F.aggregate(F.zip_with("bands_u", "bands_v", _equal_registers), F.lit(0), lambda a, x: a + x)
    return equal >= _least_equal(percent)


def _least_equal(percent: int) -> int:
    return int(REGISTERS * (percent / 100 - SLACK - 0.02))


def _equal_registers(x: Column, y: Column) -> Column:
    differ = x.bitwiseXOR(y)
    mask = F.lit(0xFFFF)
    return sum((F.when(F.shiftrightunsigned(differ, 16 * k).bitwiseAND(mask) == 0, 1).otherwise(0) for k in range(ROWS)), F.lit(0))


def _joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """The labels after further links between classes (both written rows), and whether there were any."""
    if links.isEmpty():
        return labels, False
    return components(labels.toDF("u", "v").unionByName(links), labels.count() + links.count()), True


def one_of_each(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns: the row with the least id of each component stays.
    Rows that share an id are one if their texts are equal; each other one is judged by its own text."""
    held = docs.select(as_one(docs), quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    ids = held.select("id").where("id is not null")
    repeated = checkpointed(ids.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        gone = checkpointed(near_groups(held, percent, "id", "text").where("id is not null and not kept").select("id"))
        return as_given(without(held.select("row", "id"), F.col("id"), gone), docs)
    # Each text of a repeated id gets a number of its own, above all ids.
    above = F.lit(ids.agg(F.max("id")).first()[0] + 1)
    again = held.join(repeated, "id", "left_semi").withColumn("digest", F.md5("text")).dropDuplicates(["id", "digest"]).drop("digest")
    again = checkpointed(again.withColumn("number", above + F.monotonically_increasing_id()))
    rows = without(held, F.col("id"), repeated).withColumn("number", F.col("id")).unionByName(again)
    groups = checkpointed(near_groups(rows, percent, "number", "text")).where("number is not null").join(again.select("number", "id"), "number", "left")
    groups = groups.select("component_id", F.struct(F.coalesce("id", "number").alias("id"), "number").alias("own"))
    first = groups.groupBy("component_id").agg(F.min("own").alias("first"))
    gone = checkpointed(groups.join(first, "component_id").where("own <> first").select("own.number"))
    return as_given(without(rows.select("row", "number"), F.col("number"), gone), docs)
