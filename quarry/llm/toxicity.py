"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input has character and word parts. Its hashed character n-grams (three to six, word ends marked) and the word
itself have learned vectors, and an evidence each: the signed root of the likelihood-ratio statistic of being in texts
of either label. The input is the mean vector of the n-grams plus the word's, the greatest evidence among the n-grams,
and the word's. Two gated recurrent passes, one from each end, read a window of words; attention weighs their states,
and the weighted sum gives the window's logit. A text is cut into overlapping windows that cover it whole, and its
score is that of its most toxic window, put on a probability scale by a line fitted on the labelled texts.

All is trained here in numpy, on a bounded sample of labelled rows (``MOST_TRAINING`` of each label, those with the
least hashes of their ids, equal rows once, and of these the whole texts that fit ``MOST_CHARACTERS``). The loss of each text falls on its most toxic window. A training text's evidence comes
from the texts of other folds, as it will for new texts. Only the weights (about 4 MB) go to the executors; every window
of every text is scored there.

A null or empty text, or one without a word, has the score of an empty window; equal texts have equal scores. Rows without a label, text or id teach
nothing; an id with several rows of labels is toxic if one says so. If either label has no rows, all scores are 0. Repeated rows and null ids pass; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLOCK, few_rows, give_back, in_parts, map_blocks, small_batches

#: Labelled rows that are learned from at most, for each label, and characters of their texts.
MOST_TRAINING, MOST_CHARACTERS = 2000, 8_000_000
#: Words of a window, words by which the next one starts later.
WINDOW, STEP = 48, 40
#: Bits of the buckets of evidence and of vectors, width of the vectors, states of each direction, units of the attention.
EVIDENCE_BITS, VECTOR_BITS, WIDTH, HIDDEN, LOOKS = 20, 15, 8, 8, 8
INPUT = WIDTH + 2
#: Share of words that are learned from as if they were new.
UNKNOWN = 0.25
#: Evidence is kept in whole numbers; this many are 1 to the network.
SCALE = 8
EPOCHS, BATCH, RATE, FOLDS, SEED = 6, 32, 0.01, 5, 11
#: Share of the rate by which word and n-gram vectors move; they are many, and few texts would be learned by heart.
TABLE_RATE = 0.02
GRAMS = (3, 4, 5, 6)
#: Characters of the texts that are scored together, and that are prepared together to be learned from.
TOGETHER = 500_000
#: Buckets whose evidence is worked out together: whole tables of wide numbers would be most of what the driver's Python holds.
BUCKETS = 1 << 15
THRESHOLD = 0.7

words_of = re.compile(r"\w+").findall


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, place in it of each word's first n-gram, hash of each word); every word has at least one n-gram."""
    text = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(codes))  # characters from here to the word's end
    hashes, owners = [], []
    h = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(left[: len(h)] >= n)
                hashes.append(_hash(h[at] + np.uint32(n)))
                owners.append(word[at])
        place = (np.arange(len(codes)) - (ends - lengths)[word]).astype(np.uint32)
        whole = _hash(np.add.reduceat(codes * _hash(place + np.uint32(1)), ends - lengths, dtype=np.uint32))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(hashes)[order], np.flatnonzero(np.diff(owners[order], prepend=-1)), whole


def _evidence_bucket(h: np.ndarray) -> np.ndarray:
    return h >> np.uint32(32 - EVIDENCE_BITS)


def _vector_bucket(h: np.ndarray) -> np.ndarray:
    return h & np.uint32((1 << VECTOR_BITS) - 1)


def windows(n: int) -> list[tuple[int, int]]:
    """Starts and ends of overlapping windows over n words; an empty text has one empty window."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STEP)), STEP)]


def prepare(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, windows as indexes into them (-1 where a window has ended), and the text of each window."""
    split = [words_of(t.lower()) if t else [] for t in texts]
    codes, names = pd.factorize(np.array([w for s in split for w in s], object)) if any(split) else (np.empty(0, np.int64), [])
    starts = np.cumsum([0, *map(len, split)])
    spans = [(k, starts[k] + a, starts[k] + b) for k, s in enumerate(split) for a, b in windows(len(s))]
    owner, first, last = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (np.empty(0, np.int64),) * 3
    place = first[:, None] + np.arange(WINDOW)
    inside = place < last[:, None]
    index = np.where(inside, codes[np.minimum(place, max(0, len(codes) - 1))] if len(codes) else -1, -1)
    return list(names), index, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights and scoring. Both directions run side by side: the first axis of states and inputs."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.w = {
            "chars": (r.standard_normal((1 << VECTOR_BITS, WIDTH)) * 0.05).astype(np.float32), "table": np.zeros((1 << VECTOR_BITS, WIDTH), np.float32),
            "in": small(2, INPUT, 3 * HIDDEN), "by": np.zeros((2, 1, 3 * HIDDEN), np.float32), "re": 0.5 * small(2, HIDDEN, 3 * HIDDEN),
            "look": small(2 * HIDDEN, LOOKS), "weigh": small(LOOKS, 1)[:, 0], "out": small(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32),
        }
        #: Evidence of n-grams and of words, in sixteenths.
        self.evidence = [np.zeros(1 << EVIDENCE_BITS, np.int8)] * 2
        self.line = (1.0, 0.0)

    def vectors(self, words: list[str], evidence: list[np.ndarray] | None = None) -> np.ndarray:
        """Input of each word, some thousand at a time."""
        out = np.zeros((len(words), INPUT), np.float32)
        of_grams, of_words = evidence or self.evidence
        for k in range(0, len(words), 20_000):
            grams, first, whole = features(words[k : k + 20_000])
            part = out[k : k + 20_000]
            part[:, 0] = np.maximum.reduceat(of_grams[_evidence_bucket(grams)], first) / np.float32(SCALE)
            part[:, 1] = of_words[_evidence_bucket(whole)] / np.float32(SCALE)
            count = np.diff(np.append(first, len(grams))).astype(np.float32)
            part[:, 2:] = np.add.reduceat(self.w["chars"][_vector_bucket(grams)], first, 0) / count[:, None] + self.w["table"][_vector_bucket(whole)]
        return out

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.w["in"] + self.w["by"]

    def run(self, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
        """States (window, place, units of both directions); a window's state rests where the window has ended."""
        n, length = index.shape
        states, kept = np.empty((n, length, 2 * HIDDEN), np.float32), []
        h = np.zeros((2, n, HIDDEN), np.float32)
        x = np.empty((2, n, 3 * HIDDEN), np.float32)
        on = np.empty((2, n, 1), np.float32)
        gates, own = self.w["re"][:, :, : 2 * HIDDEN], self.w["re"][:, :, 2 * HIDDEN :]
        for t in range(length):
            for d, at in enumerate((t, length - 1 - t)):
                where = index[:, at]
                np.take(inputs[d], np.maximum(where, 0), 0, out=x[d])
                on[d, :, 0] = where >= 0
            zr = _sigmoid(x[:, :, : 2 * HIDDEN] + h @ gates)
            z, r = zr[:, :, :HIDDEN] * on, zr[:, :, HIDDEN:]
            c = np.tanh(x[:, :, 2 * HIDDEN :] + (r * h) @ own)
            if keep:
                kept.append((t, h, zr[:, :, :HIDDEN], r, c, on.copy()))
            h = h + z * (c - h)
            states[:, t, :HIDDEN], states[:, length - 1 - t, HIDDEN:] = h[0], h[1]
        return states, kept

    def pool(self, states: np.ndarray, index: np.ndarray):
        looked = np.tanh(states @ self.w["look"])
        score = np.where(index >= 0, looked @ self.w["weigh"], np.float32(-1e9))
        score = np.exp(score - score.max(1, keepdims=True))
        weight = score / score.sum(1, keepdims=True)
        return looked, weight, (weight[:, None, :] @ states)[:, 0]

    def logits(self, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
        if not len(vectors):
            return np.repeat(self.w["bias"], len(index))
        inputs, got = self.inputs(vectors), []
        for k in range(0, len(index), 1024):
            states, _ = self.run(inputs, index[k : k + 1024])
            got.append(self.pool(states, index[k : k + 1024])[2] @ self.w["out"] + self.w["bias"])
        return np.concatenate(got)

    def gradients(self, vectors: np.ndarray, index: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy, for the weights and for the word vectors."""
        inputs = self.inputs(vectors)
        states, kept = self.run(inputs, index, keep=True)
        looked, weight, pooled = self.pool(states, index)
        length = index.shape[1]
        slope = ((_sigmoid(pooled @ self.w["out"] + self.w["bias"]) - target) / len(target)).astype(np.float32)
        g = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        of_pooled = slope[:, None] * self.w["out"]
        of_weight = (states @ of_pooled[:, :, None])[:, :, 0]
        of_score = weight * (of_weight - (weight * of_weight).sum(1, keepdims=True))
        g["weigh"] = np.einsum("nt,ntk->k", of_score, looked)
        of_looked = of_score[:, :, None] * self.w["weigh"] * (1 - looked * looked)
        g["look"] = np.einsum("nth,ntk->hk", states, of_looked)
        of_states = weight[:, :, None] * of_pooled[:, None, :] + of_looked @ self.w["look"].T
        gates, own = (np.swapaxes(self.w["re"][:, :, s], 1, 2) for s in (slice(0, 2 * HIDDEN), slice(2 * HIDDEN, None)))
        g["re"], of_inputs = np.zeros_like(self.w["re"]), np.zeros_like(inputs)
        carried = np.zeros((2, len(target), HIDDEN), np.float32)
        for t, h, z, r, c, on in reversed(kept):
            all_ = carried + np.stack([of_states[:, t, :HIDDEN], of_states[:, length - 1 - t, HIDDEN:]])
            moved = all_ * on
            of_c = moved * z * (1 - c * c)
            of_rh = of_c @ own
            of_zr = np.concatenate([moved * (c - h) * z * (1 - z), of_rh * h * r * (1 - r)], 2)
            back = np.swapaxes(h, 1, 2)
            g["re"][:, :, : 2 * HIDDEN] += back @ of_zr
            g["re"][:, :, 2 * HIDDEN :] += np.swapaxes(r * h, 1, 2) @ of_c
            carried = all_ - moved * z + of_rh * r + of_zr @ gates
            of_x = np.concatenate([of_zr, of_c], 2)
            for d, at in enumerate((t, length - 1 - t)):
                some = np.flatnonzero(on[d, :, 0])
                np.add.at(of_inputs[d], index[some, at], of_x[d, some])
        g["by"] = of_inputs.sum(1, keepdims=True)
        g["in"] = vectors.T @ of_inputs
        return g, (of_inputs @ np.swapaxes(self.w["in"], 1, 2)).sum(0)


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.n = w, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rows: dict[str, np.ndarray], rate: float) -> None:
        """Moves the weights; of a table only the given rows."""
        self.n += 1
        rate *= np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            at = rows.get(k, slice(None))
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * x
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * x * x
            self.w[k][at] -= (TABLE_RATE if k in rows else 1) * rate * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the likelihood-ratio statistic for each bucket, in sixteenths of four."""
    total = toxic + clean
    share = n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic, toxic * np.log(toxic / (total * share)), 0) + np.where(clean, clean * np.log(clean / (total * (1 - share))), 0))
    signed = np.sqrt(np.maximum(g, 0)) * np.where(toxic * n_clean >= clean * n_toxic, 1, -1)
    return np.clip(np.round(4 * signed), -32, 127).astype(np.int8)


def score_texts(network: Network, texts: list[str | None], evidence: list[np.ndarray] | None = None) -> np.ndarray:
    """The greatest logit of each text's windows."""
    out = [np.empty(0)]
    for low, high in in_parts([len(t or "") for t in texts], TOGETHER):
        names, index, owner = prepare(texts[low:high])
        got = network.logits(network.vectors(names, evidence), index)
        out.append(np.maximum.reduceat(got, np.flatnonzero(np.diff(owner, prepend=-1))))
    return np.concatenate(out)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learns from whole texts, and from an empty one now and then, which is clean."""
    bare = max(1, len(texts) // 20)
    texts, labels = [*texts, *[""] * bare], np.append(labels, np.zeros(bare, labels.dtype))
    network, r = Network(seed), np.random.default_rng(seed)
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])  # copies share a fold
    counts = np.zeros((FOLDS, 2, 2, 1 << EVIDENCE_BITS), np.uint16)
    for k, text in enumerate(texts):
        if names := list(dict.fromkeys(words_of(text.lower()))):
            for at in range(0, len(names), 20_000):
                grams, _, whole = features(names[at : at + 20_000])
                for part, h in enumerate((grams, whole)):
                    counts[fold[k], labels[k], part, np.unique(_evidence_bucket(h))] += 1
    n = np.array([[((fold == f) & (labels == y)).sum() for y in (0, 1)] for f in range(FOLDS)])
    of_fold = [[np.empty(1 << EVIDENCE_BITS, np.int8) for _ in (0, 1)] for _ in range(FOLDS)]
    network.evidence = [np.empty(1 << EVIDENCE_BITS, np.int8) for _ in (0, 1)]
    for part in (0, 1):
        for at in range(0, 1 << EVIDENCE_BITS, BUCKETS):
            here = slice(at, at + BUCKETS)
            sums = counts[:, :, part, here].sum(0, dtype=np.int64)
            network.evidence[part][here] = _evidence(sums[1], sums[0], *n.sum(0)[::-1])
            for f in range(FOLDS):
                rest, m = sums - counts[f, :, part, here], n.sum(0) - n[f]
                of_fold[f][part][here] = _evidence(rest[1], rest[0], *np.maximum(m, 1)[::-1])
    del counts
    give_back()
    # Each fold's texts are prepared once: words, windows and whose they are.
    parts = []
    for f in range(FOLDS):
        members = np.flatnonzero(fold == f)
        for some in np.array_split(members, max(1, -(-len(members) // 100))):
            parts += [(f, some[a:b], *prepare([texts[k] for k in some[a:b]])) for a, b in in_parts([len(texts[k]) for k in some], TOGETHER)]
    adam, logits = Adam(network.w), np.zeros(len(texts))
    turns = min(60, max(epochs, -(-4000 // len(texts)) * 2))  # few texts are read more often
    for turn in range(turns):
        picked = []  # the window of each text that is learned from: first that of most evidence, later the most toxic
        for part, (f, some, names, index, owner) in enumerate(parts):
            vectors = network.vectors(names, of_fold[f])
            if turn:
                value = network.logits(vectors, index)
            else:
                value = np.where(index >= 0, np.maximum(vectors[:, 0], 0)[np.maximum(index, 0)] if len(vectors) else 0, 0).sum(1)
            best = pd.Series(value).groupby(owner).idxmax().to_numpy()
            logits[some] = value[best]
            picked += [(part, b, labels[k]) for b, k in zip(best, some, strict=True)]
        for batch in np.array_split(r.permutation(len(picked)), -(-len(picked) // BATCH)):
            chosen = sorted(picked[k] for k in batch)
            _learn_batch(network, adam, parts, of_fold, chosen, RATE * (1 - 0.9 * turn / turns), r)
    for f, some, names, index, owner in parts:
        value = network.logits(network.vectors(names, of_fold[f]), index)
        logits[some] = np.maximum.reduceat(value, np.flatnonzero(np.diff(owner, prepend=-1)))
    network.line = _line(logits, labels)
    return network


def _learn_batch(network: Network, adam: Adam, parts: list, of_fold: list, chosen: list[tuple[int, int, int]], rate: float, r: np.random.Generator) -> None:
    """One step on the chosen (part, window, label). Some words lose their own evidence, as new words have none."""
    vectors, index, names, n = [], np.full((len(chosen), WINDOW), -1), [], 0
    for row, (part, window, _) in enumerate(chosen):
        f, _, own, all_, _ = parts[part]
        places = all_[window][all_[window] >= 0]
        seen, back = np.unique(places, return_inverse=True)
        if len(seen):
            words = [own[k] for k in seen]
            vectors.append(network.vectors(words, of_fold[f]))
            vectors[-1][r.random(len(words)) < UNKNOWN, 1] = 0
            names += words
            index[row, : len(places)] = n + back
            n += len(seen)
    if not n:
        return
    vectors = np.concatenate(vectors)
    g, of_vectors = network.gradients(vectors, index, np.array([y for *_, y in chosen], np.float32))
    grams, first, whole = features(names)
    count = np.diff(np.append(first, len(grams)))
    of_vectors = of_vectors[:, 2:]
    rows = {}
    for k, buckets, change in (("chars", _vector_bucket(grams), np.repeat(of_vectors / count[:, None], count, 0)), ("table", _vector_bucket(whole), of_vectors)):
        rows[k], back = np.unique(buckets, return_inverse=True)
        g[k] = np.zeros((len(rows[k]), WIDTH), np.float32)
        np.add.at(g[k], back, change)
    adam.step(g, rows, rate)


def _line(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset on the probability scale, by logistic regression with targets drawn in a little."""
    target = np.where(labels > 0, 0.98, 0.02)
    middle, spread = logits.mean(), logits.std() + 1e-6
    x = (logits - middle) / spread
    slope, offset = 1.0, 0.0
    for _ in range(2000):
        miss = _sigmoid(slope * x + offset) - target
        slope, offset = max(0.1, slope - 0.5 * (miss * x).mean()), offset - 0.5 * miss.mean()
    return float(slope / spread), float(offset - slope * middle / spread)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_characters: int = MOST_CHARACTERS) -> Network | None:
    """A network trained on at most ``most`` rows of each label with ``most_characters`` together; None if either label has none."""
    found = sample(docs, labels, most, most_characters, id_col, text_col, label_col)
    marks = np.array([label for _, label in found])
    if len(set(marks.tolist())) < 2:
        return None
    network = train([text for text, _ in found], marks)
    del found
    give_back()  # the driver's Python lives as long as the session
    return network


def sample(docs: DataFrame, labels: DataFrame, most: int, most_characters: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """The sorted (text, label) that are learned from. Of each label's rows, in the order of their ids' hashes, whole texts are taken
    up to the first that doesn't fit; the shortest one is if that is the first of all."""
    marked = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("label")).where(f"label in (0, 1) and {id_col} is not null").groupBy(id_col).agg(F.max("label").alias("label"))
    chosen = reduce(DataFrame.unionByName, (marked.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(most) for y in (0, 1)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    named = rows.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").withColumn("digest", F.md5("text"))
    sizes = named.select("id", "label", "digest", F.length("text").alias("n")).distinct()  # an id can stand on any number of rows
    picked = []
    for y in (0, 1):
        listed = sizes.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id", "digest").limit(most).collect()
        room, fit = most_characters, []
        for x in listed:
            room -= x["n"]
            if room < 0:  # the first that doesn't fit ends it: no choice by length
                break
            fit.append(x)
        picked += [(x["id"], x["digest"]) for x in fit or sorted(listed, key=lambda x: x["n"])[:1]]
    if not picked:
        return []
    wanted = few_rows(docs.sparkSession, picked, "id long, digest string")
    texts = named.join(F.broadcast(wanted), ["id", "digest"]).groupBy("id", "digest").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return sorted((x["text"], x["label"]) for x in texts.collect())


def score(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, what ``more`` adds, score (0 to 1) and predicted (1 from ``threshold`` on)."""
    model = docs.sparkSession.sparkContext.broadcast(network)  # tables of fixed size
    more = more or {}
    rows = docs.select(F.col(id_col).alias(id_col), *(c.alias(k) for k, c in more.items()), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def make():
        own = model.value

        def work(columns):
            *kept, texts = columns
            if own is None:
                return [*kept, [0.0] * len(texts)]
            slope, offset = own.line
            return [*kept, _sigmoid(slope * score_texts(own, texts).astype(float) + offset)]

        return work

    return map_blocks(rows, make, f"{kinds}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted to be toxic, with all their columns, whatever their names. Each text goes to a worker once, as part of its row."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                if own is None:
                    yield part
                    continue
                slope, offset = own.line
                score = _sigmoid(slope * score_texts(own, part.column(at).cast(pa.string()).to_pylist()).astype(float) + offset)
                yield part.filter(pa.array(score < threshold))
            part = None
            give_back()

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots aren't taken as they are
    return small_batches(plain).mapInArrow(run, plain.schema).toDF(*docs.columns)
