"""Search over text and vector tables, for whole tables of queries."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.clean import Report
from quarry.plans.spec import quoted
from quarry.sources.shared import written

#: Parts that rows and queries are dealt into where a vector search meets them.
BLOCKS = 64
#: Queries that a task holds at once.
GROUP = 4096
#: Bits of the bitmap of asked tokens, as a power of two.
ASKED_BITS = 17


def chunks(df: DataFrame, key: str, text: str, size: int = 1200, min_chars: int = 1) -> DataFrame:
    """(key, chunk, text): windows of ``size`` characters side by side, trimmed; those shorter than ``min_chars`` are left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda o: F.trim(F.substring(F.col(text), o + 1, F.lit(size))))
    out = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(cut).alias("chunk", "text"))
    return out.where(F.length("text") >= min_chars)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(0))


#: What ``tokens`` finds in a lower-cased text.
TOKEN = re.compile("[a-z0-9]+")
#: Postings of an Arrow batch, and bytes of the texts of one, unless the session sets them.
POSTINGS, BATCH_BYTES = 1 << 16, "8m"


def small_batches(texts: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are bounded in bytes from now on, if it hasn't bounded them itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if texts.sparkSession.conf.get(key, None) is None:
        texts.sparkSession.conf.set(key, BATCH_BYTES)
    return texts


def postings(docs: DataFrame, text: str, asked: bytes | None = None) -> DataFrame:
    """The other columns with (token, tf, length): the counts of each row's own tokens, and how many it has. Counted in the row that holds
    them, so nothing is shuffled. ``asked`` is a bitmap over the tokens' crc32; tokens without a bit are left out."""
    others = [c for c in docs.columns if c != text]
    given = docs.select(*map(quoted, others), F.lower(quoted(text)).alias(text))
    out = given.drop(text).schema.add("token", "string").add("tf", "long").add("length", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        mask = None if asked is None else len(asked) * 8 - 1

        def batch_of(rows: list[int], held: list[int], words: list[str], counts: list[int], lengths: list[int]) -> pa.RecordBatch:
            at = pa.array(np.repeat(np.array(rows, np.int64), held))
            length = pa.array(np.repeat(np.array(lengths, np.int64), held))
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(words, pa.string()), pa.array(counts, pa.int64()), length], schema=schema)

        for batch in batches:
            rows, held, words, counts, lengths = [], [], [], [], []
            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                found = TOKEN.findall(value.as_py() or "")
                own = Counter(found)
                if asked is not None:
                    own = {w: n for w, n in own.items() if asked[(at := zlib.crc32(w.encode()) & mask) >> 3] >> (at & 7) & 1}
                rows.append(row)
                held.append(len(own))
                lengths.append(len(found))
                words += own.keys()
                counts += own.values()
                if len(words) >= POSTINGS:
                    yield batch_of(rows, held, words, counts, lengths)
                    rows, held, words, counts, lengths = [], [], [], [], []
            if words:
                yield batch_of(rows, held, words, counts, lengths)

    return small_batches(given).mapInArrow(run, out)


def token_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The other columns with ``name``, how many tokens each row has; 0 for a null."""
    given = docs.select(*(quoted(c) for c in docs.columns if c != text), F.lower(quoted(text)).alias(text))
    out = given.drop(text).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            many = pa.array([len(TOKEN.findall(v.as_py() or "")) for v in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], many], schema=to_arrow_schema(out))

    return small_batches(given).mapInArrow(run, out)


def term_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, length): counts of a document's tokens, and how many it has."""
    rows = docs.select(F.col(key), tokens(F.col(text)).alias("t"))
    return rows.select(key, F.size("t").alias("length"), F.explode("t").alias("token")).groupBy(key, "token", "length").agg(F.count("*").alias("tf"))


def _asked_terms(docs: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """The term index (key, token, length, tf) of the asked tokens alone. Tokens whose bit isn't in a bitmap of fixed size are dropped where the
    text is read, and nothing is shuffled; a few pass by chance. Where keys stand more than once, counts of rows with one key and length are summed."""
    place = F.crc32(F.col("token").cast("binary")).bitwiseAND(F.lit((1 << ASKED_BITS) - 1))
    bytes_ = asked.select(F.shiftright(place, 3).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int")).alias("b"))
    bitmap = bytearray(1 << ASKED_BITS - 3)
    for r in bytes_.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # 2 ** (ASKED_BITS - 3) rows at most
        bitmap[r["w"]] = r["b"]
    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    kept = written(postings(rows, "text", bytes(bitmap)), "terms")
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return kept
    return written(kept.groupBy("key", "token", "length").agg(F.sum("tf").alias("tf")), "terms")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def keyword_topk(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 5) -> DataFrame:
    """(query, rank, key, score): per query the documents with the greatest sum of tf / length * ln(1 + N / (1 + df)) over the
    query's tokens, repeats counted. The postings of the asked tokens are written once; ``best_scores`` sums them up."""
    n = docs.agg(F.count("*").alias("n"))
    asked = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(query_text))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))
    index = _asked_terms(docs, key, text, asked)
    weight = document_frequency(index).select("token", F.ln(1 + n.scalar() / (1 + F.col("df"))).alias("idf"))
    weights = asked.join(weight, "token").select("query", "token", (F.col("times") * F.col("idf")).alias("weight"))
    return best_scores(index.select("key", "token", (F.col("tf") / F.greatest("length", F.lit(1))).alias("share")), weights, k)


def best_scores(posted: DataFrame, weights: DataFrame, k: int, blocks: int = BLOCKS) -> DataFrame:
    """(query, rank, key, score): per query the k keys with the greatest sum of share * weight over their tokens, to four places, above 0; ties by key.

    Postings (key, token, share) are dealt into blocks by key, queries (query, token, weight) into groups of about ``GROUP``, and each group goes to each
    block, where postings stream past it key by key. A task holds a group, some keys' scores and its best k so far."""
    many = weights.select(F.count_distinct(F.coalesce(F.col("query").cast("string"), F.lit("")))).first()[0]
    groups = max(1, -(-many // GROUP))
    kind, query_kind = posted.schema["key"].dataType, weights.schema["query"].dataType
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    held = posted.select(part("key", blocks).alias("block"), every(groups, "group"), F.lit(True).alias("streams"), "key", F.lit(None).cast(query_kind).alias("query"), "token", F.col("share").alias("x"))
    asked = weights.select(part("query", groups).alias("group"), "query", "token", F.col("weight").alias("x"))
    asked = asked.select(every(blocks, "block"), "group", F.lit(False).alias("streams"), F.lit(None).cast(kind).alias("key"), "query", "token", "x")
    met = held.unionByName(asked).repartition("block", "group").sortWithinPartitions("block", "group", "streams", "key")
    out = met.select("block", "query", "key", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        at, group = None, Asked(k)
        for batch in batches:
            block, part, streams = (np.asarray(batch.column(c)) for c in ("block", "group", "streams"))
            cuts = np.flatnonzero(np.diff(block) | np.diff(part) | (streams[1:] != streams[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if low == high:
                    continue
                if at is not None and at != (block[low], part[low]):
                    yield group.result(int(at[0]), schema)
                    group = Asked(k)
                at = (block[low], part[low])
                rows = batch.slice(low, high - low)
                (group.meet if streams[low] else group.ask)(rows)
        if at is not None:
            yield group.result(int(at[0]), schema)

    return _best(met.mapInArrow(run, out), k, "block")


class Asked:
    """Queries that one block's postings stream past, sorted by key, and the best k of each so far."""

    #: Scores of keys and queries that are summed up at once.
    CELLS = 1 << 21

    def __init__(self, k: int):
        self.k, self.parts, self.rest = k, [], None
        self.names: pa.Array | None = None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows.select(["query", "token", "x"]))

    def _built(self) -> None:
        if self.names is None and self.parts:
            rows = pa.Table.from_batches(self.parts).combine_chunks()
            query, token = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query", "token"))
            self.names, self.tokens = query.dictionary, token.dictionary
            order = np.argsort(np.asarray(token.indices), kind="stable")
            self.query, self.weight = np.asarray(query.indices)[order], np.asarray(rows.column("x"))[order]
            self.ends = np.cumsum(np.bincount(np.asarray(token.indices), minlength=len(self.tokens)))
            self.scores = np.zeros((0, len(self.names)))
            self.keys = np.empty((0, len(self.names)), object)
            self.parts = []

    def meet(self, rows: pa.RecordBatch) -> None:
        self._built()
        if self.names is None:
            return
        rows = rows.select(["key", "token", "x"])
        table = pa.Table.from_batches([rows] if self.rest is None else [*self.rest.to_batches(), rows]).combine_chunks()
        keys = table.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        place = np.asarray(keys.indices)
        whole = int(np.searchsorted(place, place[-1]))  # the last key may go on in the next batch
        self.rest = table.slice(whole)
        self._score(keys.dictionary.to_pylist(), place[:whole], table.slice(0, whole))

    def _score(self, names: list, place: np.ndarray, rows: pa.Table) -> None:
        token = np.asarray(pc.index_in(rows.column("token").combine_chunks(), value_set=self.tokens).fill_null(-1))
        share = np.asarray(rows.column("x"))
        step, n = max(1, self.CELLS // len(self.names)), len(self.names)
        keys = int(place[-1]) + 1 if len(place) else 0
        for first in range(0, keys, step):
            low, high = np.searchsorted(place, [first, first + step])
            own = low + np.flatnonzero(token[low:high] >= 0)
            many = np.diff(self.ends, prepend=0)[token[own]]
            row = np.repeat(own, many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.ends[token[own]] - many, many)
            last = min(first + step, keys)
            sums = np.bincount((place[row] - first) * n + self.query[at], share[row] * self.weight[at], (last - first) * n).reshape(last - first, n)
            self._keep(np.floor(sums * 10_000 + 0.5) / 10_000, names[first:last])

    def _keep(self, scores: np.ndarray, names: list) -> None:
        """Those that stand first are kept of equals: keys come in their order."""
        if len(self.scores) == self.k:
            better = np.flatnonzero((scores > self.scores[-1]).any(axis=1))
            scores, names = scores[better], [names[i] for i in better]
        label = np.empty(len(names), object)
        label[:] = names
        scores = np.concatenate([self.scores, scores])
        keys = np.concatenate([self.keys, np.repeat(label[:, None], scores.shape[1], axis=1)])
        order = np.argsort(-scores, axis=0, kind="stable")[: self.k]
        self.scores, self.keys = np.take_along_axis(scores, order, 0), np.take_along_axis(keys, order, 0)

    def result(self, block: int, schema: pa.Schema) -> pa.RecordBatch:
        self._built()
        if self.rest is not None:
            keys = self.rest.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
            self._score(keys.dictionary.to_pylist(), np.asarray(keys.indices), self.rest)
        place, query = np.nonzero(self.scores > 0) if self.names is not None else (np.empty(0, int), np.empty(0, int))
        score = [float(self.scores[p, q]) for p, q in zip(place, query, strict=True)]
        key = [self.keys[p, q] for p, q in zip(place, query, strict=True)]
        names = self.names.take(pa.array(query)) if self.names is not None else pa.array([], schema.field("query").type)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(score), pa.int32()), names, pa.array(key, schema.field("key").type), pa.array(score)], schema=schema)


def _best(scores: DataFrame, k: int, part: str) -> DataFrame:
    """The best k of each part of a query's scores, then the best k of those."""
    order = [F.desc("score"), "key"]
    local = scores.withColumn("r", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def vector_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, k: int = 5, blocks: int = BLOCKS) -> DataFrame:
    """(query, rank, key, score): per query the vectors of greatest cosine, exactly, to four places; ties by key. Vectors of another length
    than the query, without a value or of length 0 have no score.

    Vectors are dealt into blocks, queries into groups of ``GROUP``, and each group goes to each block, where vectors stream past it: one matrix product for each
    Arrow batch. A task holds a group and its best k so far."""
    groups = max(1, -(-queries.count() // GROUP))
    kind = vectors.schema[key].dataType.simpleString()
    query_kind = queries.schema[query_key].dataType.simpleString()
    double = F.transform(quoted(vector), lambda x: x.cast("double")).alias("v")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    held = vectors.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), every(groups, "group"), F.lit(True).alias("streams"), quoted(key).alias("key"), F.lit(None).cast(query_kind).alias("query"), double)
    asked = queries.select(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int").alias("group"), quoted(query_key).alias("query"), double)
    asked = asked.select(every(blocks, "block"), "group", F.lit(False).alias("streams"), F.lit(None).cast(kind).alias("key"), "query", "v")
    met = held.unionByName(asked).where("v is not null").repartition("block", "group").sortWithinPartitions("block", "group", "streams")
    out = met.select("block", "query", "key", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        at, group = None, Group(k)
        for batch in batches:
            block, part, streams = (np.asarray(batch.column(c)) for c in ("block", "group", "streams"))
            cuts = np.flatnonzero(np.diff(block) | np.diff(part) | (streams[1:] != streams[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if low == high:
                    continue
                if at is not None and at != (block[low], part[low]):
                    yield group.result(int(at[0]), schema)
                    group = Group(k)
                at = (block[low], part[low])
                rows = batch.slice(low, high - low)
                (group.meet if streams[low] else group.ask)(rows)
        if at is not None:
            yield group.result(int(at[0]), schema)

    return _best(met.mapInArrow(run, out), k, "block")


class Group:
    """Queries that one block's vectors stream past, and the best k of each so far."""

    def __init__(self, k: int):
        self.k, self.names, self.matrices = k, [], {}
        self.parts: list[pa.RecordBatch] = []

    def ask(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    @staticmethod
    def _units(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, unit vectors) for each length; those with a null, or no direction, are left out."""
        column = rows.column("v")
        sizes = np.diff(np.asarray(column.offsets))
        values = column.flatten()
        numbers = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for n in np.unique(sizes[sizes > 0]):
            places = np.flatnonzero(sizes == n)
            matrix = numbers[starts[places][:, None] + np.arange(n)]
            norm = np.sqrt((matrix * matrix).sum(1))
            good = norm > 0
            yield int(n), places[good], matrix[good] / norm[good, None]

    def _built(self) -> None:
        if self.parts:
            rows = pa.Table.from_batches(self.parts).combine_chunks().to_batches()
            for part in rows:
                first, names = len(self.names), part.column("query").to_pylist()
                self.names += names
                for n, places, units in self._units(part):
                    self.matrices.setdefault(n, []).append((places + first, units))
            self.matrices = {n: (np.concatenate([p for p, _ in x]), np.concatenate([u for _, u in x])) for n, x in self.matrices.items()}
            self.best: list[list] = [[] for _ in self.names]
            self.parts = []

    def meet(self, rows: pa.RecordBatch) -> None:
        self._built()
        if not self.names:
            return
        keys = rows.column("key")
        for n, places, units in self._units(rows):
            if n not in self.matrices or not len(places):
                continue
            asked, matrix = self.matrices[n]
            names = keys.take(pa.array(places))
            order = np.argsort(np.array(names.to_pylist(), object if pa.types.is_string(names.type) else None), kind="stable")
            scores = np.maximum(0.0, np.floor(matrix @ units[order].T * 10_000 + 0.5) / 10_000)
            sorted_names = names.take(pa.array(order)).to_pylist()
            for row, query in enumerate(asked):
                own = scores[row]
                if len(own) > self.k:
                    least = np.partition(own, len(own) - self.k)[len(own) - self.k]
                    above = np.flatnonzero(own > least)
                    some = np.concatenate([above, np.flatnonzero(own == least)[: self.k - len(above)]])  # the first keys of equals
                else:
                    some = np.arange(len(own))
                best = self.best[query] + [(-float(own[i]), sorted_names[i]) for i in some]
                self.best[query] = sorted(best)[: self.k]

    def result(self, block: int, schema: pa.Schema) -> pa.RecordBatch:
        self._built()
        found = [(block, self.names[q], key, -score) for q, best in enumerate(getattr(self, "best", [])) for score, key in best]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], f.type) for c, f in enumerate(schema)], schema=schema)


def upsert(old: DataFrame, new: DataFrame, key: str, replace: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key is new, added to ``old``; with ``replace``, ``old``'s rows that agree with ``new`` in those columns go first."""
    if replace:
        old = old.join(new.select(*replace).distinct(), list(replace), "left_anti")
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


#: What business words in column names mean, in order; the first that a name holds is attached.
GLOSSARY = (
    ("sales", "Money taken for goods sold."), ("revenue", "Money taken in a period."), ("profit", "What is left of sales once costs are paid."),
    ("discount", "Share taken off the list price."), ("quantity", "Number of units."), ("price", "Money asked for one unit."), ("cost", "Money spent on what was sold."),
    ("tax", "Share of the price due to the state."), ("segment", "Group of similar customers."), ("region", "Part of the world that is sold to."),
    ("priority", "How soon an order is to be dealt with."), ("status", "Stage that a record has reached."), ("date", "Day on which it happened."),
    ("type", "Kind of thing."), ("customer", "Who buys."), ("value", "Amount that was measured."),
)


def glossary(columns: DataFrame, entries: Sequence[tuple[str, str]] = GLOSSARY) -> DataFrame:
    """The rows of ``columns`` with the definition of the first entry that the column's name holds, or null."""
    terms = columns.sparkSession.createDataFrame([(k, t, d) for k, (t, d) in enumerate(entries)], "k int, term string, definition string")
    held = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("term")) for k, (t, _) in enumerate(entries)))
    first = F.get(F.filter(held, lambda e: F.contains(F.lower("column"), e["term"])), F.lit(0))["k"]
    return columns.withColumn("k", first).join(F.broadcast(terms), "k", "left").drop("k")


def metadata_documents(profile: DataFrame, entries: Sequence[tuple[str, str]] = GLOSSARY) -> DataFrame:
    """(id, dataset, kind, column, text): an overview and a dictionary of each dataset and a card of each column, from
    profile rows (dataset, position, column, role, kind, unique, missing_pct)."""
    named = glossary(profile, entries)
    # A dataset's columns fit one row; all of its documents come from that row, so the profile is worked out once.
    about = F.struct("position", "column", "role", "kind", F.col("unique").cast("string").alias("unique"), "definition")
    sets = named.groupBy("dataset").agg(F.array_sort(F.collect_list(about)).alias("columns"))

    def of_role(role: str) -> Column:
        return F.array_join(F.transform(F.filter("columns", lambda c: c["role"] == role), lambda c: c["column"]), ", ")

    said = [x for label, role in (("Metrics", "metric"), ("Dimensions", "dimension"), ("Dates", "date"), ("Identifiers", "identifier"), ("Texts", "text")) for x in (F.lit(f" {label}: "), of_role(role), F.lit("."))]
    overview = F.concat(F.lit("Table "), "dataset", F.lit(": "), F.size("columns").cast("string"), F.lit(" columns."), *said)
    dictionary = F.array_join(F.transform("columns", lambda c: F.concat_ws(" / ", c["column"], c["role"], c["kind"], c["unique"])), "\n")
    doc = lambda kind, column, text: F.struct(F.lit(kind).alias("kind"), column.alias("column"), text.alias("text"))
    card = lambda c: F.concat(F.lit("Column "), c["column"], F.lit(" of "), F.col("dataset"), F.lit(": "), c["role"], F.lit(", "), c["kind"], F.lit(", "), c["unique"], F.lit(" distinct values."), F.coalesce(F.concat(F.lit(" "), c["definition"]), F.lit("")))
    every = F.concat(F.array(doc("overview", F.lit(""), overview), doc("dictionary", F.lit(""), dictionary)), F.transform("columns", lambda c: doc("column", c["column"], card(c))))
    rows = sets.select("dataset", F.explode(every).alias("d")).select("dataset", "d.*")
    return rows.select(F.concat_ws("::", "dataset", "kind", F.nullif(F.col("column"), F.lit(""))).alias("id"), "dataset", "kind", "column", "text")


def statistics_documents(stats: DataFrame) -> DataFrame:
    """(id, dataset, kind, column, text): one text a dataset on its numbers, from rows (dataset, position, column, minimum, maximum, mean, median, std)."""
    two = lambda c: F.coalesce(F.round(c, 2).cast("decimal(38,2)").cast("string"), F.lit("none"))
    line = F.concat(F.lit("- "), "column", F.lit(": "), two("minimum"), F.lit(" to "), two("maximum"), F.lit(", mean "), two("mean"), F.lit(", median "), two("median"), F.lit(", std "), two("std"), F.lit("."))
    return _of_datasets(stats.select("dataset", "position", line.alias("line")), "statistics", "Numbers of ")


def rules_documents(derived: DataFrame) -> DataFrame:
    """One text a dataset on the ratios that its metrics allow, from rows (dataset, position, name, numerator, denominator, scale)."""
    times = F.when(F.col("scale") != 1, F.concat(F.lit(", times "), F.col("scale").cast("int").cast("string"))).otherwise("")
    line = F.concat(F.lit("- "), "name", F.lit(": sum of "), "numerator", F.lit(" over sum of "), "denominator", times, F.lit("."))
    return _of_datasets(derived.select("dataset", "position", line.alias("line")), "business_rules", "Measures of ")


def _of_datasets(lines: DataFrame, kind: str, title: str) -> DataFrame:
    """A dataset's lines, as many as it has columns or ratios, under a title."""
    text = F.concat(F.lit(title), "dataset", F.lit(":\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    whole = lines.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("all"))
    return whole.select(F.concat_ws("::", "dataset", F.lit(kind)).alias("id"), "dataset", F.lit(kind).alias("kind"), F.lit("").alias("column"), text.alias("text"))


def cleaning_document(spark: SparkSession, dataset: str, report: Report) -> DataFrame:
    """One text on what cleaning changed."""
    before, after = report.before, report.after
    said = [f"Cleaning of {dataset}: {before['rows']} rows of {before['columns']} columns were read, {after['rows']} rows of {after['columns']} columns are left."]
    if before["rows"] > after["rows"]:
        said.append(f"{before['rows'] - after['rows']} rows were empty or repeated another.")
    lists = (("Renamed", [f"{' '.join(a.split()) or 'a blank name'} to {b}" for a, b in report.renamed.items()]), ("Dropped", [*report.empty_columns, *report.index_columns]), ("Read as numbers", report.numbers), ("Read as dates", report.dates), ("Day first", report.day_first), ("Warnings", report.warnings))
    said += [f"{title}: {', '.join(names)}." for title, names in lists if names]
    return spark.createDataFrame([(f"{dataset}::cleaning", dataset, "cleaning", "", " ".join(said))], "id string, dataset string, kind string, column string, text string")
