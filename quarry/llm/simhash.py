"""Near-duplicate groups by SimHash fingerprints, paired by vantage-point trees.

A fingerprint's bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of a text's shingles of three words,
repeats included; a text with fewer words has one shingle, one without words the fingerprint zero. Fingerprints link if at
most ``radius`` bits differ.

Equal fingerprints are one point. A vantage-point tree, whose vantage points and boundaries come from a bounded sample of the points
(``SAMPLE`` a round), deals all of them into shards: a point within a node's boundary distance of its vantage point goes
to the inner side, any other to the outer one. Shards that hold too many points are divided further by samples of their own. A pair
that a node parts has its inner point within ``radius`` of the boundary by the triangle inequality, so such
points visit the outer side as well, and there all sides that their radius reaches. Each shard's points are then searched
with a tree of their own, for them and for the visitors, pruned by the same bounds. So every pair is found. Of the points of a
shard that link with one another only a spanning star goes on, and one link of a visitor to each star: dense groups aren't expanded into pairs.
Components of the stars are those of all links.

Null and empty texts and those of white space have the fingerprint zero and are linked like any other. Rows that share
an id, repeated or with different texts, are one document that links by any of its fingerprints; each gets a row. Rows
without an id link with nothing and have no component. Other columns aren't read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, id_and_text, map_blocks, mix, signed, word_bytes
from quarry.llm.near_dedup import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Points that the shard tree is fitted on in each round, and points of a shard at most (16 bytes each).
SAMPLE, MOST_HELD = 65_536, 1 << 20
#: Vantage points tried for a node, points that they are tried on, and points of a leaf, which are compared one by one.
TRIED, TRIED_ON, LEAF = 12, 512, 48
#: Queries that meet a leaf together; bounds a task's memory.
TOGETHER = 4096


def shingle_hashes(words: list[bytes]) -> list[int]:
    """Hashes of the shingles, repeats included."""
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprint(words: list[bytes]) -> int:
    """The fingerprint as an unsigned number."""
    hashes = np.array(shingle_hashes(words), np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print): the fingerprint of each row as a signed long."""

    def make():
        def work(columns):
            ids, texts = columns
            return [ids, signed(np.array([fingerprint(word_bytes(t)) for t in texts], np.uint64))]

        return work

    return map_blocks(id_and_text(docs, id_col, text_col), make, f"{id_col} long, print long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Tree:
    """Nodes of a vantage-point tree; a child below zero is the leaf of number -1 - child."""

    vantage: list[int] = field(default_factory=list)
    within: list[int] = field(default_factory=list)
    sides: list[list[int]] = field(default_factory=list)
    leaves: int = 1
    root: int = -1

    def divide(self, leaf: int, points: np.ndarray, parts: int) -> None:
        """Puts a tree of about ``parts`` leaves, fitted on the points, in place of a leaf; the leaf's number goes to one of them."""
        todo = [(points, parts, None)]
        free = [leaf]
        while todo:
            some, n, above = todo.pop()
            cut = _boundary(some) if n > 1 and len(some) > 1 else None
            if cut is None:
                if not free:
                    free.append(self.leaves)
                    self.leaves += 1
                me = -1 - free.pop()
            else:
                me = len(self.vantage)
                vantage, within = cut
                self.vantage.append(int(vantage))
                self.within.append(int(within))
                self.sides.append([0, 0])
                inner = distance(some, vantage) <= within
                share = min(n - 1, max(1, round(n * inner.mean())))
                todo += [(some[~inner], n - share, (me, 1)), (some[inner], share, (me, 0))]
            if above is not None:
                self.sides[above[0]][above[1]] = me
            elif leaf == 0 and self.root == -1:
                self.root = me
            else:
                for k, sides in enumerate(self.sides):
                    if -1 - leaf in sides and k != me:
                        sides[sides.index(-1 - leaf)] = me
                        break

    def deal(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of the points that it holds, places of its visitors) for each leaf that any point reaches."""
        none = np.empty(0, np.int64)
        todo = [(self.root, np.arange(len(points)), none)]
        while todo:
            node, own, visitors = todo.pop()
            if not len(own) and not len(visitors):
                continue
            if node < 0:
                yield -1 - node, own, visitors
                continue
            vantage, within, (inner, outer) = np.uint64(self.vantage[node]), self.within[node], self.sides[node]
            d, e = distance(points[own], vantage), distance(points[visitors], vantage)
            todo.append((inner, own[d <= within], visitors[e <= within + radius]))
            todo.append((outer, own[d > within], np.concatenate([own[(d <= within) & (d > within - radius)], visitors[e > within - radius]])))


def _boundary(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that part the points well: few of them near the boundary, neither side small. None if all are equal."""
    on = points[:: max(1, len(points) // TRIED_ON)]
    best, least = None, np.inf
    for vantage in points[:: max(1, len(points) // TRIED)]:
        count = np.bincount(distance(on, vantage), minlength=65).astype(float)
        inner = np.cumsum(count) / len(on)
        near = np.convolve(count, np.ones(2 * RADIUS), "full")[RADIUS:][:65] / len(on)  # points at most RADIUS beyond or inside of each distance
        cost = (near + 0.05) / np.minimum(inner, 1 - inner).clip(1e-9)
        at = int(cost.argmin())
        if 0 < inner[at] < 1 - 1e-12 and cost[at] < least:
            best, least = (vantage, at), cost[at]
    if best is None:  # no vantage point tried parts the sample: any two points that differ do
        other = points[points != points[0]]
        return (points[0], 0) if len(other) else None
    return best


class Groups:
    """Union-find over numbered points."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        for x, y in set(zip(a[differ].tolist(), b[differ].tolist(), strict=True)):
            while self.parent[x] != x:
                x = self.parent[x]
            while self.parent[y] != y:
                y = self.parent[y]
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def linked(points: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The group of each point (its least place) among the points of a shard, and (visitor, group) pairs, each once or a few times."""
    tree = Tree()
    if len(points) > LEAF:
        tree.divide(0, points, -(-len(points) // LEAF))
    groups, held = Groups(len(points)), {}

    def close(queries: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the queries, place among the points) of what is close, some thousand queries at a time."""
        for k in range(0, len(queries), TOGETHER):
            for j in range(0, len(own), 4 * LEAF):
                row, at = np.nonzero(distance(queries[k : k + TOGETHER, None], points[own[j : j + 4 * LEAF]]) <= radius)
                yield row + k, own[j + at]

    for leaf, own, near in tree.deal(points, radius):
        if len(own):
            held[leaf] = own
            asking = np.concatenate([own, near])
            for row, at in close(points[asking], own):
                groups.link(asking[row], at)
    met = []
    for k in range(0, len(visitors), TOGETHER):
        todo = [(tree.root, np.arange(k, min(k + TOGETHER, len(visitors))))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node >= 0:
                d = distance(visitors[rows], np.uint64(tree.vantage[node]))
                todo.append((tree.sides[node][0], rows[d <= tree.within[node] + radius]))
                todo.append((tree.sides[node][1], rows[d > tree.within[node] - radius]))
            elif (own := held.get(-1 - node)) is not None:
                for row, at in close(visitors[rows], own):
                    if len(row):
                        met.append(np.unique(np.stack([rows[row], groups.roots(at)]), axis=1))
    return groups.roots(np.arange(len(points))), met


def shard_tree(points: DataFrame, radius: int, parts: int, most: int = MOST_HELD) -> Tree:
    """A tree whose leaves hold about equal shares of the points, ``parts`` of them or more."""
    total = points.count()
    size = max(1, min(most, -(-total // parts)))
    tree, counts = Tree(), {0: total}
    for _ in range(64):
        large = {k: n for k, n in counts.items() if n > 2 * size}
        if not large:
            break
        share = min(1.0, SAMPLE / sum(large.values()))
        drawn = _sample(points, tree, large, share, radius)
        before = tree.leaves
        for leaf in sorted(large):
            if len(own := drawn.get(leaf, ())) > 1:
                tree.divide(leaf, own, min(len(own) // 4 + 1, -(-large[leaf] // size)))
        if tree.leaves == before:
            break
        counts = dict(_count(points, tree, radius))
    return tree


def _sample(points: DataFrame, tree: Tree, large: dict[int, int], share: float, radius: int) -> dict[int, np.ndarray]:
    """Points of the leaves, drawn by hash: about ``SAMPLE`` in all. The driver holds no more."""
    shared = points.sparkSession.sparkContext.broadcast(tree)
    bound = int(share * (1 << 63))

    def make():
        def work(columns):
            prints = np.array(columns[0], np.int64).view(np.uint64)
            prints = prints[(mix(prints) >> np.uint64(1)) < np.uint64(bound)] if share < 1 else prints
            got = [(leaf, int(p)) for leaf, own, _ in shared.value.deal(prints, radius) if leaf in large for p in signed(prints[own])]
            return [[k for k, _ in got], [p for _, p in got]]

        return work

    drawn: dict[int, list[int]] = {}
    for leaf, p in map_blocks(points.select("print"), make, "leaf int, print long", block=8192).collect():
        drawn.setdefault(leaf, []).append(p)
    return {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in drawn.items()}


def _count(points: DataFrame, tree: Tree, radius: int) -> list[tuple[int, int]]:
    """(leaf, points) of each leaf."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def make():
        def work(columns):
            got = [(leaf, len(own)) for leaf, own, _ in shared.value.deal(np.array(columns[0], np.int64).view(np.uint64), radius)]
            return [[k for k, _ in got], [n for _, n in got]]

        return work

    counted = map_blocks(points.select("print"), make, "leaf int, n long", block=8192).groupBy("leaf").agg(F.sum("n").alias("n"))
    return [(r["leaf"], r["n"]) for r in counted.collect()]


def links(points: DataFrame, radius: int, parts: int, most: int = MOST_HELD) -> DataFrame:
    """(u, v): links between the points (print, rep) by their reps, enough to join all that are linked."""
    tree = shard_tree(points, radius, parts, most)
    shared = points.sparkSession.sparkContext.broadcast(tree)  # 40 bytes a shard

    def make():
        def work(columns):
            prints, reps = np.array(columns[0], np.int64).view(np.uint64), np.array(columns[1], np.int64)
            out: list[list] = [[], [], [], []]
            for leaf, own, visitors in shared.value.deal(prints, radius):
                for visits, some in ((False, own), (True, visitors)):
                    out[0].append(np.full(len(some), leaf, np.int32))
                    out[1].append(np.full(len(some), visits))
                    out[2].append(signed(prints[some]))
                    out[3].append(reps[some])
            return [np.concatenate(x) for x in out]

        return work

    dealt = map_blocks(points.select("print", "rep"), make, "shard int, visits boolean, print long, rep long", block=8192)
    met = dealt.repartition(max(parts, tree.leaves), "shard").sortWithinPartitions("shard", "visits")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                if shards[low] != at and parts:
                    yield from _of_shard(parts, radius, schema)
                    parts = []
                at = shards[low]
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from _of_shard(parts, radius, schema)

    return met.mapInArrow(run, "u long, v long")


def _of_shard(parts: list[pa.RecordBatch], radius: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    visits, prints, reps = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("visits", "print", "rep"))
    prints, homes = prints.view(np.uint64), ~visits
    own, others = reps[homes], reps[visits]
    groups, met = linked(prints[homes], prints[visits], radius)
    star = groups != np.arange(len(groups))
    yield pa.RecordBatch.from_arrays([pa.array(own[star]), pa.array(own[groups[star]])], schema=schema)
    for visitor, group in met:
        yield pa.RecordBatch.from_arrays([pa.array(others[visitor]), pa.array(own[group])], schema=schema)


def simhash_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_HELD) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id reachable over links."""
    table = checkpointed(fingerprint_table(docs, id_col, text_col))
    named = table.where(f"{id_col} is not null")
    points = checkpointed(named.groupBy("print").agg(F.min(id_col).alias("rep")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = links(points, radius, parts, most).unionByName(_of_one_id(named, points, id_col))
    labels = components(edges)
    classes = points.join(labels.toDF("rep", "label"), "rep", "left").select("print", F.coalesce("label", "rep").alias("label"))
    rows = table.join(classes, "print", "left")
    component = F.when(F.col(id_col).isNotNull(), F.col("label")).alias("component_id")
    return rows.select(id_col, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component)


def _of_one_id(named: DataFrame, points: DataFrame, id_col: str) -> DataFrame:
    """The links (u, v) between the points of an id that stands on different fingerprints."""
    several = named.groupBy(id_col).agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select(id_col)
    reps = named.join(several, id_col).select(id_col, "print").distinct().join(points, "print").select(id_col, "rep")
    least = reps.groupBy(id_col).agg(F.min("rep").alias("v"))
    return reps.join(least, id_col).where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
