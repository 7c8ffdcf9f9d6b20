"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is cut so that every piece has the largest size C // k of a reciprocal-capacity class that still fits; the bins of the
class hold exactly C // size pieces. Each worker fills its classes' bins by itself, so there is no shuffle and a worker keeps less
than one bin of each class. Pieces of bins that stay open at the end are laid end to end and cut anew; the last tokens go into
sequences of powers of two."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.runtime import released

CAPACITY = 1024
#: Words whose ids a task keeps, and rows and bytes of one batch that it returns.
CACHED_WORDS, OUT_ROWS, OUT_BYTES = 600_000, 20_000, 8 << 20


class _Odd(Exception):
    """The text has runs of white space, for which its words can't be looked up one by one."""


class ByteBPE(dict):
    """Token ids, as little-endian unsigned 32-bit numbers, by the vocabulary in a tokenizers file.

    Text in which all white space is single is cut at blanks and line ends, where this pre-tokenizer always cuts, and each word's
    ids are looked up. Other texts are encoded whole; texts that hold a special token, by the tokenizers library itself. All three
    ways give the same ids."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = self.whole.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        bare = word[1:] if word[:1] == "\n" else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise _Odd
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self.packed(self.ordinary(word if word[0] == "\n" else " " + word))
        if len(word) < 40:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        words = text.replace("\n", " \n").split(" ")
        head = words[0]
        if head and not head[0].isspace() and not head[-1].isspace():
            try:
                words[0] = self.packed(self.ordinary(head))
                words[1:] = map(self.__getitem__, words[1:])
                return b"".join(words)
            except _Odd:
                pass
        return self.packed(self.ordinary(text))


_bpe: dict[tuple, ByteBPE] = {}


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> ByteBPE:
    """One for each worker process, for all its tasks."""
    key = (json_path, ranks_path, pattern)
    if key not in _bpe:
        _bpe[key] = ByteBPE(*key)
    return _bpe[key]


def class_sizes(capacity: int) -> list[int]:
    """For each length up to the capacity, the size of the piece to cut off: the largest capacity // k that fits; small lengths stay whole."""
    sizes = sorted({capacity // k for k in range(1, capacity + 1)})
    out, i = [0], -1
    for r in range(1, capacity + 1):
        while i + 1 < len(sizes) and sizes[i + 1] <= r:
            i += 1
        out.append(sizes[i])
    return out


class Bins:
    """Open bins by piece size. A piece is (document's key, start, ids, document's tokens)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.cut = capacity, first_id, class_sizes(capacity)
        self.open: dict[int, list[tuple]] = {}

    def closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield key, start, len(ids) // 4, ids, total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        start = 0
        while start < total:
            size = self.cut[min(total - start, self.capacity)]
            piece = (key, start, ids[4 * start : 4 * (start + size)], total)
            start += size
            own = self.open.setdefault(size, [])
            own.append(piece)
            if len(own) == self.capacity // size:
                yield from self.closed(self.open.pop(size))

    def rest(self) -> Iterator[tuple]:
        """The pieces of open bins, laid end to end and cut to full sequences, then to powers of two."""
        pieces = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in pieces)
        now: list[tuple] = []
        room = 0
        for key, start, ids, total in pieces:
            while ids:
                if not room:
                    if now:
                        yield from self.closed(now)
                    now, room = [], self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                size = min(room, len(ids) // 4)
                now.append((key, start, ids[: 4 * size], total))
                start, ids, room, left = start + size, ids[4 * size :], room - size, left - size
        if now:
            yield from self.closed(now)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Every document's ids end with end_id, so null and empty texts have one id. Each id lies in one piece; in a sequence offsets
    leave no gap. Rows that repeat are packed each for itself; a null doc_id stays null. Other columns are not read; an empty
    table gives no rows. A lost task is run again on the same rows and numbers its sequences alike."""
    from pyspark import TaskContext

    mark = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, ranks_path, pattern)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        try:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for row in bins.add(key, bpe.encode(text.as_py() or "") + mark):
                        rows.append(row)
                        held += len(row[3])
                        if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                            yield batch_of()
                            rows, held = [], 0
            rows.extend(bins.rest())
            if rows:
                yield batch_of()
        finally:
            bpe.clear()  # the words; a worker that waits or does something else holds the vocabulary only

    shape = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), shape)
