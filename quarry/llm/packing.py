"""Best-fit packing with large-item matching.

Each text becomes its token ids and one end id; texts longer than a sequence are cut into whole sequences and a rest.
Pieces of one whole sequence stand alone. Of the others, items above a third of the capacity fit at most twice in a
bin: from the largest down, each is matched with the largest partner that still fits. Smaller items then go, from the
largest down, to the bin whose gap they leave smallest, or open a new bin.

The rows to pack are a few numbers a piece. They are dealt evenly over tasks (Spark splits and joins the deals by
size) and packed in groups of a bounded number, so no group or driver holds them all; a group leaves one bin partly
filled at most.

A null or empty text is the end id alone. Repeated rows are packed each by itself, null ids are kept, other columns
aren't read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import attrgetter
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import id_and_text, map_blocks

#: Pieces packed together at most.
GROUP = 100_000
#: Code points below this are split here; a text with any other goes to the library whole.
PLAIN = 0x250
#: Texts whose words are looked up together.
BLOCK = 1024
#: Bytes of the words that a task remembers; of digits and signs an eighth of that.
MOST_BYTES = 48 << 20
ID = attrgetter("id")
_LOADED: dict = {}


class Remembered(dict):
    """Packed 32-bit ids of words as ``find`` gives them, remembered up to a bound in bytes, here and in ``old`` together: when
    half of it is full of words asked for since the last time, those asked for before go. So rare words don't drive out frequent ones."""

    #: What an entry takes beside its word and ids: the objects' heads and the place in the table.
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.half, self.held, self.old = most_bytes // 2, 0, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.find(word)
        if len(word) <= 48:
            size = self.ENTRY + len(word) + len(got)
            self.held += size
            if self.held > self.half:
                self.old, self.held = dict(self), size
                self.clear()
            self[word] = got
        return got


class WordIds(Remembered):
    """Parts of words, for a word-end BPE file; texts of plain characters are put together from words."""

    def __init__(self, library, most_bytes: int):
        super().__init__(most_bytes)
        self.library, self.tokenize = library, library.model.tokenize
        # How the file's byte-level step writes bytes: printable ones as they are, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        of = lambda kinds: re.escape("".join(chr(c) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds))
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^\s{of('LN')}]+").findall
        self.other = re.compile(r"[\x1c-\x1f\x85İɐ-\U0010ffff]|<\|").search

    def odd(self, text: str) -> bool:
        """Whether the text has marked strings or what lower-cases or splits otherwise than here; it is left to the library."""
        try:
            plain = text.encode("latin-1")  # most texts; their bytes are looked through faster
        except UnicodeEncodeError:
            return self.other(text) is not None
        return b"<|" in plain or len(plain.translate(None, b"\x1c\x1d\x1e\x1f\x85")) < len(plain)

    def find(self, part: str) -> bytes:
        if not (part.isascii() and part.isalpha()):
            part = part.encode().decode("latin-1").translate(self.bytes)
        ids = [*map(ID, self.tokenize(part))]
        return struct.pack(f"<{len(ids)}I", *ids)


class Whole(Remembered):
    """Runs of letters; ``parts`` remembers digits and signs. Of texts, each distinct word between white space is looked up
    once in a call, and Arrow puts the ids together."""

    def __init__(self, parts: WordIds, most_bytes: int):
        super().__init__(most_bytes)
        self.parts, self.find = parts, parts.find

    def mixed(self, low: str) -> bytes:
        core = low.rstrip(punctuation)
        if core.isalpha():  # most of them: letters, then signs to the end, which are one part
            return self[core] + self.parts[low[len(core) :]]
        return b"".join([self[part] if part.isalpha() else self.parts[part] for part in self.parts.split(low)])

    def of_texts(self, texts: list[str]) -> list[bytes]:
        odd = [self.parts.odd(text) for text in texts]
        words = pc.utf8_split_whitespace(pa.array(["" if o else text.lower() for o, text in zip(odd, texts, strict=True)], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = pa.array([self[word] if word.isalpha() else self.mixed(word) for word in known], pa.large_binary()).take(coded.indices)
        _, ends, ids = packed.buffers()
        ends, ids = np.frombuffer(ends, np.int64), memoryview(ids or b"")
        at = ends[words.offsets.to_numpy()].tolist()
        return [self.by_library(text) if o else bytes(ids[i:j]) for o, text, i, j in zip(odd, texts, at, at[1:], strict=False)]

    def by_library(self, text: str) -> bytes:
        ids = self.parts.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        return self.of_texts([text])[0]


def word_ids(path: str, most_bytes: int = MOST_BYTES) -> Whole:
    """A task's own; workers outlive their tasks, and keep the file alone."""
    from tokenizers import Tokenizer

    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
    return Whole(WordIds(_LOADED[path], most_bytes // 8), most_bytes)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids with the end id, cut at the capacity."""

    def make():
        ids = word_ids(tokenizer)
        end = end_id.to_bytes(4, "little")

        def work(columns):
            out = [[], [], [], [], []]
            keys, texts = columns
            for key, packed in zip(keys, ids.of_texts([text or "" for text in texts]), strict=True):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    for column, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            return out

        return work

    return map_blocks(id_and_text(docs, id_col, text_col), make, f"{id_col} long, piece int, start long, length long, ids_crc32 long", BLOCK)


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; see the module's words on the method."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for item, length in enumerate(lengths):
        by_length[length].append(item)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    gaps: dict[int, list[int]] = defaultdict(list)  # bins by what they still take; a bit of open_ tells that there are any
    open_, bins = 0, 0
    large = sum(1 << n for n in by_length if 3 * n > capacity)
    while large:
        n = large.bit_length() - 1
        item = by_length[n].pop()
        if not by_length[n]:
            large ^= 1 << n
        placed[item] = (bins, 0)
        gap = capacity - n
        if fits := large & ((1 << (gap + 1)) - 1):
            m = fits.bit_length() - 1
            placed[by_length[m].pop()] = (bins, n)
            if not by_length[m]:
                large ^= 1 << m
            gap -= m
        gaps[gap].append(bins)
        open_ |= 1 << gap
        bins += 1
    for n in sorted((n for n in by_length if 3 * n <= capacity), reverse=True):
        for item in by_length[n]:
            if fit := open_ >> n:
                gap = n + (fit & -fit).bit_length() - 1
                at = gaps[gap].pop()
                if not gaps[gap]:
                    open_ ^= 1 << gap
            else:
                at, gap, bins = bins, capacity, bins + 1
            placed[item] = (at, capacity - gap)
            gaps[gap - n].append(at)
            open_ |= 1 << (gap - n)
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col).hint("rebalance")
    out = docs.sparkSession.createDataFrame([], f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40

        def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal first
            whole = pa.Table.from_batches(rows).combine_chunks()
            places = pack(whole.column("length").to_pylist(), capacity)
            sequence = pa.array([first + b for b, _ in places], pa.int64())
            first += 1 + max(b for b, _ in places)
            return whole.append_column("sequence_id", sequence).append_column("offset", pa.array([o for _, o in places], pa.int64()))

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                held.append(part := batch.slice(at, 1000))
                n += part.num_rows
                if n >= group:
                    yield from packed(held).to_batches()
                    held, n = [], 0
        if n:
            yield from packed(held).to_batches()

    return cut.mapInArrow(run, out)
