"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no piece of the vocabulary can reach across (before white space, around characters without a
piece, between a letter or digit and a full stop or comma if no piece joins them). Each unit is a linked list of
symbols; a heap holds its adjacent pairs by rank, and the lowest is merged again and again. Tokens are the initial
symbols less the merges, where a character without a piece counts its UTF-8 bytes. No identifiers are made. Counts
of units are remembered up to a bound.

Nulls and empty texts count 0 bytes and 0 tokens. Repeated rows, null ids and extra columns pass without effect:
one row goes out per row that comes in.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, map_blocks

SPACE = "▁"
_LOADED: dict = {}


def merge(ids: list[int], pairs: dict[int, int], width: int) -> int:
    """Merge a list of symbols in place by rank and return the merges made; -1 stands where a symbol has gone.

    A symbol's number is its rank. ``pairs`` maps (left << width | right) to the merged symbol. The heap's numbers
    hold the rank above the place, so that equal ranks are taken from the left.
    """
    n = len(ids)
    bits = n.bit_length()
    place, get = (1 << bits) - 1, pairs.get
    heap = []
    a = ids[0]
    for i in range(1, n):
        b = ids[i]
        if (m := get(a << width | b)) is not None:
            heap.append(m << bits | i - 1)
        a = b
    if not heap:
        return 0
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        e = heappop(heap)
        i = e & place
        if (a := ids[i]) < 0 or (j := after[i]) >= n or get(a << width | ids[j]) != (new := e >> bits):
            continue
        ids[i] = new
        ids[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := get(new << width | ids[k])) is not None:
                heappush(heap, m << bits | i)
        if (k := before[i]) >= 0 and (m := get(ids[k] << width | new)) is not None:
            heappush(heap, m << bits | k)
    return merges


class PieceCounts(dict):
    """Token counts of units for a piece model with byte fallback."""

    def __init__(self, path: str, most: int = 900_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranks = {model.id_to_piece(i): k for k, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.none, self.width = len(ranks), len(ranks).bit_length()
        self.most, self.symbols, self.pairs = most, {p: k for p, k in ranks.items() if len(p) == 1}, {}
        for p, rank in ranks.items():
            for k in range(1, len(p)):
                if (a := ranks.get(p[:k])) is not None and (b := ranks.get(p[k:])) is not None:
                    self.pairs[a << self.width | b] = rank
        if any(SPACE in p.lstrip(SPACE) for p in ranks):
            raise ValueError("pieces reach across white space; the text can't be cut there")
        joined = re.escape("".join(sorted({p[k] for p in ranks for k in range(len(p) - 1) if p[k + 1] in ".,"})))
        loose = "" if "\n" in self.symbols else "\n"  # a character without a piece takes part in no merge
        self.words = Words(self)
        self.units = re.compile(rf"{SPACE}*(?:[^\W_{joined}]+(?=[.,])|[^{SPACE}{loose}]+)|{SPACE}+|{loose}").findall

    def __missing__(self, unit: str) -> int:
        ids = list(map(self.symbols.get, unit))
        total = len(ids)
        if None in ids:
            total += sum(len(ch.encode("utf-8", "surrogatepass")) - 1 for ch, i in zip(unit, ids, strict=True) if i is None)
            ids = [self.none if i is None else i for i in ids]
        total -= merge(ids, self.pairs, self.width)
        if len(self) >= self.most:
            self.clear()
        if len(unit) <= 48:
            self[unit] = total
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[0] == " " or "  " in text or SPACE in text:  # runs of spaces make pieces of their own
            return sum(map(self.__getitem__, self.units(SPACE + text.replace(" ", SPACE))))
        return sum(map(self.words.__getitem__, text.split(" ")))


class Words(dict):
    """Token counts of what stands between single spaces, from those of its units."""

    def __init__(self, counts: PieceCounts):
        self.counts = counts

    def __missing__(self, word: str) -> int:
        total = sum(map(self.counts.__getitem__, self.counts.units(SPACE + word)))
        if len(self) >= self.counts.most:
            self.clear()
        if len(word) <= 48:
            self[word] = total
        return total


def piece_counts(path: str) -> PieceCounts:
    """One for each worker process and model."""
    if path not in _LOADED:
        _LOADED[path] = PieceCounts(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens of the piece model at ``model``, and whether the tokens exceed ``limit``."""

    def make():
        counts = piece_counts(model)

        def work(columns):
            ids, texts = columns
            return [ids, [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], [counts.count(t) for t in texts]]

        return work

    got = map_blocks(id_and_text(docs, id_col, text_col), make, f"{id_col} long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
