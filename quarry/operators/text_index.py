"""A keyword index that is kept: postings by token, in batches that merge without the old texts.

Each batch holds its postings (token, block, key, tf, length), written where the texts are read, in shelves of tokens; the
greatest tf / length of each token in each block, and how many post it there; its documents; the keys that it takes out of earlier batches; and what it
adds to document frequencies and sizes, less what it takes out. Blocks are runs of documents of similar length, so
that long documents, whose shares are small, stand together. A batch counts once its line of sizes is written, last.

Texts without a token are documents of length 0. Rows without a key are left out; a batch holds each key once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.retrieval import best_scores, postings, token_counts, tokens
from quarry.plans.spec import quoted
from quarry.sources.shared import written

#: Folders that the tokens of a batch are dealt into, and documents of a block.
SHELVES, BLOCK_DOCUMENTS = 16, 256
#: Blocks whose lengths are told apart, and blocks of a query that are scored before any is left out.
BANDS, FIRST = 64, 2
SIZES = "batch int, documents long, tokens long"
#: How far a bound may lie below a score that it bounds, by rounding in sums of doubles and to four places.
SLACK = 1e-4


def shelf(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SHELVES)).cast("int")


@dataclass
class Searched:
    """The postings that a search had to score, one for each query that needs it, and all that its tokens post."""

    read: DataFrame
    all: DataFrame


class TextIndex:
    """The index kept at ``path``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", key_type: str = "long", block_documents: int = BLOCK_DOCUMENTS):
        self.spark, self.path, self.key_type, self.block_documents = spark, path, key_type, block_documents
        self.key = key
        self.held: dict[tuple[int, ...], dict[int, tuple[int, int]]] = {}
        self.schemas = {
            "postings": f"token string, block int, key {key_type}, tf long, length long, shelf int", "blocks": "token string, block int, most double, posted long, shelf int",
            "documents": f"key {key_type}, length long, label string", "gone": f"key {key_type}", "frequencies": "token string, df long, shelf int",
        }

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole."""
        return [r["batch"] for r in self._sizes().orderBy("batch").collect()]  # one row a batch

    def _sizes(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], SIZES)
        return self.spark.read.schema(SIZES).parquet(f"{self.path}/sizes")

    def _kept(self, name: str, batches: list[int] | None = None) -> DataFrame:
        """With the number of the batch."""
        parts = [self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/batch-{b}").withColumn("batch", F.lit(b)) for b in (self.batches() if batches is None else batches)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schemas[name] + ", batch int")

    def _until(self) -> DataFrame:
        """(key, until): the last batch that takes the key out."""
        return self._kept("gone").groupBy("key").agg(F.max("batch").alias("until"))

    def _counts(self) -> dict[int, tuple[int, int]]:
        """For each batch, its documents and how many of them later batches have taken out."""
        batches = tuple(self.batches())
        if batches not in self.held:
            met = self._kept("documents").select("key", "batch").join(self._until(), "key", "left").groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("until") > F.col("batch")).alias("out"))
            found = {r["batch"]: (r["n"], r["out"]) for r in met.collect()}  # one row a batch
            self.held = {batches: {b: found.get(b, (0, 0)) for b in batches}}
        return self.held[batches]

    def _alive(self) -> list[int]:
        """Batches that hold a document that no later one has taken out; the others needn't be read."""
        return [b for b, (n, out) in self._counts().items() if out < n]

    def _live(self, name: str) -> DataFrame:
        """Rows (key, batch and more) of documents that no later batch has taken out. Only in batches that have lost some documents, not all, are keys matched."""
        whole = [b for b in self._alive() if not self._counts()[b][1]]
        some = [b for b in self._alive() if self._counts()[b][1]]
        rows = self._kept(name, whole)
        if not some:
            return rows
        left = self._kept(name, some).join(self._until(), "key", "left").where("until is null or batch >= until").drop("until")
        return rows.unionByName(left) if whole else left

    def size(self) -> DataFrame:
        """One row: documents and tokens."""
        zero = F.lit(0).cast("long")
        return self._sizes().agg(F.coalesce(F.sum("documents"), zero).alias("documents"), F.coalesce(F.sum("tokens"), zero).alias("tokens"))

    def documents(self) -> DataFrame:
        return self._live("documents").select("key", "length", "label")

    def postings(self) -> DataFrame:
        """(key, token, tf, length) of all live documents."""
        return self._live("postings").select("key", "token", "tf", "length")

    def frequencies(self) -> DataFrame:
        """(token, df), from the batches' lines of difference."""
        return self._kept("frequencies").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def add(self, docs: DataFrame, text: str, label: str | None = None) -> int:
        """Adds the documents whose keys are new; others stay as they are. The number of the batch."""
        return self._batch(docs, text, label, None)

    def replace(self, docs: DataFrame, text: str, label: str | None = None, by_label: bool = False) -> int:
        """The documents take the place of those with their keys and, ``by_label``, of all with one of their labels."""
        rows = self._rows(docs, text, label)
        old = self.documents()
        out = old.join(rows.select("key").distinct(), "key", "left_semi").select("key")
        if by_label:
            out = out.unionByName(old.join(rows.select("label").distinct(), "label", "left_semi").select("key"))
        return self._batch(docs, text, label, out.distinct())

    def remove(self, keys: DataFrame) -> int:
        """Takes out the documents whose keys are in the single column."""
        gone = self.documents().join(keys.toDF("key").distinct(), "key", "left_semi").select("key")
        return self._batch(self.spark.createDataFrame([], f"{self.key} {self.key_type}, text string"), "text", None, gone)

    def compact(self, path: str) -> TextIndex:
        """An index of one batch with the same live documents at another path, made from the postings alone."""
        out = TextIndex(self.spark, path, self.key, self.key_type, self.block_documents)
        out._write(0, self.documents(), self.postings(), None)
        return out

    def _rows(self, docs: DataFrame, text: str, label: str | None) -> DataFrame:
        made = F.lit(None).cast("string") if label is None else quoted(label).cast("string")
        return docs.select(quoted(self.key).cast(self.key_type).alias("key"), quoted(text).cast("string").alias("text"), made.alias("label")).where("key is not null")

    def _batch(self, docs: DataFrame, text: str, label: str | None, out: DataFrame | None) -> int:
        rows = self._rows(docs, text, label)
        repeated = rows.groupBy("key").count().where("count > 1").select("key").limit(3).collect()
        if repeated:
            raise ValueError(f"keys stand more than once: {[r['key'] for r in repeated]}")
        if out is None:
            rows = rows.join(self.documents().select("key"), "key", "left_anti")
        number = max(self.batches(), default=-1) + 1
        documents = token_counts(rows, "text", "length")
        self._write(number, documents, postings(rows.select("key", "text"), "text"), out)
        return number

    def _write(self, number: int, documents: DataFrame, postings: DataFrame, out: DataFrame | None) -> None:
        """All parts of a batch: documents (key, label, length), postings (key, token, tf, length) and the keys that it takes out."""
        to = lambda name: f"{self.path}/{name}/batch-{number}"
        columns = lambda name: [c.split()[0] for c in self.schemas[name].split(", ")]
        read = lambda name: self.spark.read.schema(self.schemas[name]).parquet(to(name))

        def save(df: DataFrame, name: str) -> None:
            df.select(*columns(name)).write.mode("overwrite").partitionBy(*[c for c in ("shelf",) if c in columns(name)]).parquet(to(name))

        nothing = self.spark.createDataFrame([], self.schemas["gone"])
        before = self._counts()
        old = {name: self._live(name) for name in ("documents", "postings")}
        save(nothing if out is None else out, "gone")
        save(documents, "documents")
        total = [F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")]
        size = read("documents").agg(*total).first()

        # Blocks of documents of similar length: where a block ends matters to speed alone, so about even ends do.
        many = max(1, -(-size["n"] // self.block_documents))
        bands = min(many, BANDS)
        ends = read("documents").agg(F.percentile_approx("length", F.array(*(F.lit(k / bands) for k in range(1, bands))), 1000).alias("e")).first()["e"] if bands > 1 else []
        ends = sorted(set(ends))
        band = reduce(Column.__add__, (F.when(F.col("length") > e, 1).otherwise(0) for e in ends), F.lit(0))
        within = max(1, -(-many // (len(ends) + 1)))
        block = (band * within + F.pmod(F.xxhash64("key"), F.lit(within))).cast("int")
        save(postings.withColumn("block", block).withColumn("shelf", shelf(F.col("token"))).sortWithinPartitions("shelf"), "postings")
        most = read("postings").groupBy("token", "block", "shelf").agg(F.max(F.col("tf") / F.col("length")).alias("most"), F.count("*").alias("posted"))
        save(most.sortWithinPartitions("shelf"), "blocks")

        change = read("blocks").select("token", F.col("posted").alias("d"))
        n_out = t_out = 0
        if out is not None:
            for taken in old["documents"].join(read("gone"), "key", "left_semi").groupBy("batch").agg(*total).collect():  # one row a batch
                n_out, t_out, batch = n_out + taken["n"], t_out + int(taken["t"]), taken["batch"]
                # A batch that loses all of its documents at once loses all of its postings.
                lost = self._kept("postings", [batch]) if before[batch] == (taken["n"], 0) else old["postings"].where(F.col("batch") == batch).join(read("gone"), "key", "left_semi")
                change = change.unionByName(lost.select("token", F.lit(-1).cast("long").alias("d")))
        delta = change.groupBy("token").agg(F.sum("d").cast("long").alias("df")).where("df <> 0").withColumn("shelf", shelf(F.col("token")))
        save(delta.sortWithinPartitions("shelf"), "frequencies")
        self.spark.createDataFrame([(number, size["n"] - n_out, int(size["t"]) - int(t_out))], SIZES).coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def search(self, queries: DataFrame, query_key: str, query_text: str, k: int = 5) -> tuple[DataFrame, Searched]:
        """(query, rank, key, score), the k best documents of each query by the sum of tf / length * ln(1 + N / (1 + df)) over its tokens, repeats
        counted, rounded to four places; and what was read for it.

        Block maxima bound a query's scores in each block. The ``FIRST`` blocks of the greatest bounds are scored first. If they
        hold k documents, no document of a block whose bound is below the k-th score is among the best; the other blocks are scored."""
        asked = queries.select(quoted(query_key).alias("query"), F.explode(tokens(quoted(query_text))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))
        shelves = [r["s"] for r in asked.select(shelf(F.col("token")).alias("s")).distinct().collect()]  # at most SHELVES
        n = self.size().first()["documents"]
        on_shelf = F.col("shelf").isin(shelves)
        weights = asked.join(self._kept("frequencies").where(on_shelf).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"), "token")
        weights = weights.select("query", "token", (F.col("times") * F.ln(1 + F.lit(n) / (1 + F.col("df")))).alias("weight"))
        bounds = weights.join(self._kept("blocks", self._alive()).where(on_shelf), "token").groupBy("query", "batch", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
        bounds = written(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "batch", "block"))), "bounds")
        live = self._live("postings").where(on_shelf)
        needed = lambda pairs: live.join(pairs.select("query", "batch", "block").join(weights, "query"), ["token", "batch", "block"])

        def scored(pairs: DataFrame) -> DataFrame:
            scores = needed(pairs).groupBy("query", "batch", "block", "key").agg(F.sum(F.col("tf") / F.col("length") * F.col("weight")).alias("score"))
            return _best(scores.withColumn("score", F.round("score", 4)).where("score > 0"), k)

        first = written(scored(bounds.where(F.col("place") <= FIRST)), "first")
        least = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        others = bounds.where(F.col("place") > FIRST).join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        # What other queries need is scored too: where a query doesn't need a block, what it scores there, in part or whole, is below its k best.
        wanted = others.select("query", "batch", "block").join(weights, "query").select("token", "batch", "block").distinct()
        posted = live.join(wanted, ["token", "batch", "block"], "left_semi").select("key", "token", (F.col("tf") / F.col("length")).alias("share"))
        rest = best_scores(posted, weights, k).select("query", "key", "score")
        whole = first.select("query", "key", "score").unionByName(rest).groupBy("query", "key").agg(F.max("score").alias("score"))
        best = whole.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key")))).where(F.col("rank") <= k)
        read = needed(bounds.where(F.col("place") <= FIRST)).unionByName(needed(others))
        return best.select("query", "rank", "key", "score"), Searched(read, needed(bounds))


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The best k of each block of a query, then of those of the query."""
    order = [F.desc("score"), F.asc("key")]
    local = scores.withColumn("r", F.row_number().over(Window.partitionBy("query", "batch", "block").orderBy(*order))).where(F.col("r") <= k)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query", "batch", "block", "key", "score", "rank")
