"""Benchmark decontamination by Wu-Manber search over words.

Words are hashed; a block is two adjacent words. For patterns of one length m a block table tells how far a window may be shifted;
only a shift of 0 looks into the bucket of patterns that end in that block, and its words are then compared directly. Texts are cut
into lanes that overlap by m - 1 words, and all lanes of a batch are scanned in step."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm import kernels as K
from crawlweave.runtime import released

U = np.uint64
WINDOW, LANE = 10, 256
#: Bytes of benchmark text behind one broadcast; a larger benchmark is searched in several passes.
CHUNK_BYTES = 8 << 20
TABLE_LOG2 = 20


class Matcher:
    """Patterns of one length: a shift table over hashed blocks, buckets by the last block, and where their words stand in `low`."""

    def __init__(self, length: int, w: K.Words, h: np.ndarray, begin: np.ndarray, number: np.ndarray):
        """begin: the first word of each window among all words w of the items (hashes h); number: its item."""
        self.length, self.block = length, min(2, length)
        whole = self.whole(h, begin)
        order = np.lexsort((number, whole))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        first = order[new]
        again = np.ones(len(order), bool)  # an item's second window of the same words
        again[1:] = new[1:] | (number[order][1:] != number[order][:-1])
        self.items = number[order][again]
        self.bounds = np.append(np.flatnonzero(new[again]), len(self.items))
        self.first, self.low, self.start, self.end = begin[first], w.low, w.start, w.end  # of all items' words, shared by the matchers
        block, most = self.blocks(h), length - self.block + 1
        self.shift = np.full(1 << TABLE_LOG2, min(most, 255), np.uint8)
        for j in range(most):
            np.minimum.at(self.shift, block[self.first + j] >> U(64 - TABLE_LOG2), min(most - 1 - j, 255))
        self.last = np.unique(block[self.first + most - 1])
        self.pattern = whole[first]  # ascending

    def blocks(self, h: np.ndarray) -> np.ndarray:
        return K.mixed(h) if self.block == 1 else K.mixed(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])

    def whole(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.full(len(begin), U(self.length))
        for j in range(self.length):
            out = K.mixed(out * U(0x9E3779B97F4A7C15) + h[begin + j])
        return out

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Last word of every window that a pattern may end in; first: bounds of the texts' words."""
        m, keep = self.length, []
        begin, end = first[:-1], first[1:]
        long = np.flatnonzero(end - begin >= m)
        if not len(long):
            return np.zeros(0, np.int64)
        ends = end[long] - begin[long] - (m - 1)  # window ends in each text
        lanes = -(-ends // LANE)
        text = np.repeat(np.arange(len(long)), lanes)
        lane = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[long][text] + m - 1 + lane * LANE
        stop = np.minimum(at + LANE, end[long][text])
        block = self.blocks(h)
        back = self.block - 1
        while len(at):
            here = block[at - back]
            jump = self.shift[(here >> U(64 - TABLE_LOG2)).astype(np.int64)]
            hit = jump == 0
            keep.append(at[hit])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        found = np.sort(np.concatenate(keep))
        last = block[found - back]
        return found[self.last[np.minimum(np.searchsorted(self.last, last), len(self.last) - 1)] == last]

    def occurrences(self, w: K.Words, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence. Of a bucket the pattern of the window's digest is compared, word by word and byte by byte."""
        begin = self.candidates(h, first) - self.length + 1
        if not len(begin):
            return begin, begin
        key = self.whole(h, begin)
        p = np.minimum(np.searchsorted(self.pattern, key), len(self.pattern) - 1)
        good = self.pattern[p] == key
        begin, p = begin[good], p[good]
        size = w.end - w.start
        for j in range(self.length):
            own, other = begin + j, self.first[p] + j
            same = size[own] == self.end[other] - self.start[other]
            begin, p, own, other = begin[same], p[same], own[same], self.start[other[same]]
            n = size[own]
            if not len(n):
                break
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = w.low[np.repeat(w.start[own], n) + place] == self.low[np.repeat(other, n) + place]
            same = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            begin, p = begin[same], p[same]
        return begin, p

    def items_of(self, text: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distinct (text, item) of occurrences."""
        if not len(p):
            return np.zeros((0, 2), np.int64)
        pair = np.unique(np.stack((text, p), axis=1), axis=0)
        n = np.diff(self.bounds)[pair[:, 1]]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.stack((np.repeat(pair[:, 0], n), self.items[np.repeat(self.bounds[pair[:, 1]], n) + place]), axis=1)


def matchers(items: list[tuple[int, str]], window: int) -> list[Matcher]:
    """One for each length of windows: `window` words, or all words of an item that has fewer."""
    raw, at = K.text_bytes(pa.array([t for _, t in items], pa.large_string()))
    w = K.Words(raw, at, K.ALNUM)
    h, first, numbers = w.hashes(), w.first(), np.array([n for n, _ in items], np.int64)
    count = np.diff(first)
    out = []
    for length in np.unique(np.minimum(count, window)).tolist():
        if length:
            own = np.flatnonzero(np.minimum(count, window) == length)
            windows = count[own] - length + 1
            begin = np.repeat(first[own], windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            out.append(Matcher(length, w, h, begin, np.repeat(numbers[own], windows)))
    return out


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and each value's row; null lists are empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), size)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list column of n rows from values that are ordered by row."""
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1))), pa.array(values, pa.int64())).cast(pa.list_(pa.int64()))


def _search(found):
    """Adds to n_words, spans (flat begin and end words, merged) and items (their numbers) what one part of the benchmark finds.

    All occurrences of a batch stay in arrays; spans and items are made once per text, so the work is linear in words and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = found.value
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            raw, at = K.text_bytes(column("text"))
            had, had_row = _flat(column("spans"))
            items = [np.stack(_flat(column("items"))[::-1], axis=1)]
            words, edges, rows = np.zeros(batch.num_rows, np.int64), [], []
            for i, j in K.slices(at):
                w = K.Words(raw[at[i] : at[j]], at[i : j + 1] - at[i], K.ALNUM)
                h, first = w.hashes(), w.first()
                words[i:j] = np.diff(first)
                depth = np.zeros(len(h) + 1, np.int64)
                own = (had_row >= i) & (had_row < j)
                place = had[own] + first[had_row[own] - i]
                np.add.at(depth, place[::2], 1)
                np.add.at(depth, place[1::2], -1)
                for m in tables:
                    if len(h) < m.length:
                        continue
                    begin, p = m.occurrences(w, h, first)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + m.length, -1)
                    items.append(m.items_of(w.doc[begin] + i, p) if len(begin) else items[0][:0])
                covered = np.cumsum(depth)[:-1] > 0
                before = np.zeros(len(h), bool)
                before[1:] = covered[:-1] & (w.doc[1:] == w.doc[:-1])
                after = np.zeros(len(h), bool)
                after[:-1] = covered[1:] & (w.doc[1:] == w.doc[:-1])
                begin, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
                text = w.doc[begin]
                edges.append(np.stack((begin - first[text], end - first[text]), axis=1).ravel())
                rows.append(np.repeat(text + i, 2))
            spans = _lists(np.concatenate(rows or [words[:0]]), np.concatenate(edges or [words[:0]]), batch.num_rows)
            pair = np.unique(np.concatenate(items), axis=0)
            kept = [c for c in batch.schema.names if c not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays([*map(column, kept), pa.array(words, pa.int64()), spans, _lists(pair[:, 0], pair[:, 1], batch.num_rows)], names=[*kept, "n_words", "spans", "items"])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(text, ...) with n_words, spans (begin and end words of merged occurrences, flat) and items (ids of items found, ascending).

    Each pass holds one bounded chunk of the benchmark; passes follow each other without a shuffle. Null and empty texts have no
    words; items of no words, null texts or null ids have no windows; repeated items count once, also if an id has several texts; rows
    of docs stay as they are, repeated or not. Own columns of those three names are replaced, all others stay; `clean` keeps all."""
    spark = docs.sparkSession
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<long>")})
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    kept = [f for f in out.schema.fields if f.name not in ("n_words", "spans", "items")]
    more = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType()))]
    for c in range(chunks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).distinct().collect()  # about chunk_bytes
        tables = spark.sparkContext.broadcast(matchers([(r[0], r[1]) for r in rows], window))
        out = out.select(*[f.name for f in kept], "n_words", "spans", "items").mapInArrow(released(_search(tables)), T.StructType([*kept, *more]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs(text, ...) in which no window of the benchmark occurs, with all their own columns, whatever their names."""
    found = find_benchmark(docs.select(F.struct(*docs.columns).alias("row"), "text"), benchmark, window)
    return found.where(F.size("spans") == 0).select("row.*")


def items_digest(column):
    """sha256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(column, lambda x: x.cast("string"))), ","), 256)


def brute_force(text: str | None, items: list[tuple[int, str]], window: int = WINDOW) -> tuple[int, int, int, str]:
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(fold))
    words = split(text)
    hit, ids = set(), set()
    for number, item in items:
        own = split(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(number)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
