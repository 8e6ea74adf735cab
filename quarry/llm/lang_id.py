"""Language identification by multilingual mixture inference.

Character trigrams of letters (a space stands for any run of others) are hashed into a fixed number of buckets and
counted per language over all labelled texts given to learn from; smoothed shares are the n-gram likelihoods. For each
document, expectation-maximisation estimates the proportions of a mixture of languages. Sets grow from the best single
language by the one with the next largest proportion, as long as the penalised likelihood improves. The language with
the largest proportion in the chosen set is predicted, with that proportion as score.

A null text or one without a letter is ``und`` with score 0. If there is nothing to learn from, all texts are. Ties go
to the language first in the alphabet. Empty tables give none; repeated rows and null ids pass; other columns aren't
read, and only the text is an input of a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_blocks, small_batches

BITS = 15
BUCKETS = 1 << BITS
UNDETERMINED = "und"
#: Rounds of expectation-maximisation, and the price of a further language in trigrams' worth of log-likelihood.
ROUNDS, PRICE = 12, 4.0
#: Languages that are learned at most; more is an error, as the table of likelihoods goes to every executor.
MOST_LANGUAGES = 400
_FOLD: list = []


def _fold() -> np.ndarray:
    """For every code point its lower-case form, or a space if it isn't a letter."""
    if not _FOLD:
        fold = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                fold[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _FOLD.append(fold)
    return _FOLD[0]


def trigrams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of the folded text; None if it has no letter."""
    if not text:
        return None
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])  # one space for a run
    codes = codes[keep]
    codes = np.concatenate([[32] if codes[0] != 32 else [], codes, [32] if codes[-1] != 32 else []]).astype(np.uint32)
    if len(codes) < 3:
        codes = np.concatenate([codes, [32]]).astype(np.uint32)
    x = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - BITS)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and log-likelihoods (bucket, language), from all rows with a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (grams := trigrams(text.as_py())) is not None:
                    if lang not in sums:
                        if len(sums) >= MOST_LANGUAGES:
                            raise ValueError("too many languages")
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(grams, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = small_batches(rows).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row a language, each of a fixed length: all that the driver sees.
    found = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    found.sort(key=lambda r: r["lang"])
    table = np.zeros((BUCKETS, len(found)), np.float64)
    for k, r in enumerate(found):
        at, n = zip(*r["counts"], strict=True)
        table[list(at), k] = n
    table += 0.2
    return [r["lang"] for r in found], np.log(table / table.sum(0)).astype(np.float32)


def _mixture(doc: np.ndarray, like: np.ndarray, n: np.ndarray, allowed: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document's mixture over its allowed languages."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = share[doc] * like
        part *= (n / np.maximum(part.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(part, starts, 0) / total[:, None]
    logs = n * np.log(np.maximum((share[doc] * like).sum(1), 1e-30))
    return share, np.add.reduceat(logs, starts)


def infer(grams: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (document, language) for documents given by their trigrams, none of them empty."""
    found = [np.unique(g, return_counts=True) for g in grams]
    doc = np.repeat(np.arange(len(grams)), [len(b) for b, _ in found])
    bucket, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    total = np.array([len(g) for g in grams], np.float64)
    rows = logs[bucket].astype(np.float64)
    shift = rows.max(1)  # keeps the likelihoods of a trigram near 1
    like = np.exp(rows - shift[:, None])
    languages = logs.shape[1]
    share, _ = _mixture(doc, like, n, np.ones((len(grams), languages)), total)
    order = np.argsort(-share, 1, kind="stable")
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    alone = np.add.reduceat(n[:, None] * (rows - shift[:, None]), starts, 0)
    best = alone.argmax(1)
    chosen = np.eye(languages)[best]
    value = alone[np.arange(len(grams)), best]
    going = np.arange(len(grams))
    for size in range(2, languages + 1):
        allowed = np.zeros((len(going), languages))
        np.put_along_axis(allowed, order[going, :size], 1.0, 1)
        if size == 2:  # the best single language stays in
            allowed[np.arange(len(going)), best[going]] = 1.0
        member = np.isin(doc, going)
        renamed = np.searchsorted(going, doc[member])
        got, score = _mixture(renamed, like[member], n[member], allowed, total[going])
        better = score - PRICE * (size - 1) * np.log(total[going] + 1) > value[going]
        chosen[going[better]] = got[better]
        value[going[better]] = score[better] - PRICE * (size - 1) * np.log(total[going[better]] + 1)
        going = going[better]
        if not len(going):
            break
    return chosen, value


def predict(docs: DataFrame, languages: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, what ``more`` adds, lang_pred, score, and the proportions of the chosen languages as a text."""
    model = docs.sparkSession.sparkContext.broadcast((languages, logs))  # at most MOST_LANGUAGES * BUCKETS numbers
    more = more or {}
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *(c.alias(k) for k, c in more.items()), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def make():
        names, table = model.value

        def work(columns):
            *kept, texts = columns
            grams = [trigrams(t) if names else None for t in texts]
            with_letters = [k for k, g in enumerate(grams) if g is not None]
            langs, scores, mixes = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
            if with_letters:
                shares, _ = infer([grams[k] for k in with_letters], table)
                for k, share in zip(with_letters, shares, strict=True):
                    top = int(share.argmax())
                    langs[k], scores[k] = names[top], float(min(1.0, share[top]))
                    mixes[k] = ",".join(f"{names[i]}:{share[i]:.3f}" for i in np.argsort(-share, kind="stable") if share[i] >= 0.0005)
            return [*kept, langs, scores, mixes]

        return work

    return map_blocks(rows, make, f"{kinds}, lang_pred string, score double, mixture string")
