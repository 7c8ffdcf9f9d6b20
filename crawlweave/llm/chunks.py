"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text may be cut where a word begins, in long words at bytes whose hash says so, and where neither came for long: its steps. A chunk begins at the
step of the least hash among any WINDOW steps in a row, where a hash is that of the 8 bytes before it. So an insertion moves only the
chunks near it, no chunk is long, and a passage has the same chunks wherever it stands, but for CONTEXT + WINDOW - 1 words before the first
and WINDOW after the last: every passage of 50 words has a run of at least LEAST_STEPS steps. Chunks are counted by 128-bit digest; those
of two documents or more are joined back, and chunks that follow each other form a span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.llm import kernels as K
from crawlweave.runtime import written

U = np.uint64
#: Bytes that a hash has seen, and the most words that these can touch.
GEAR_WINDOW, CONTEXT = 8, 4
#: Steps of which one begins a chunk, words of a passage that is always found, and steps of a run that counts.
WINDOW, PASSAGE = 16, 50
LEAST_STEPS = PASSAGE - CONTEXT - 2 * WINDOW + 1
#: After LONG_WORD bytes without a blank one byte in 2**STEP_LOG2 is a step by its hash; a step comes after GAP bytes without any.
LONG_WORD, STEP_LOG2, GAP = 32, 5, 64
_rng = np.random.Generator(np.random.PCG64(0x6EA2))
GEAR = _rng.integers(0, 2**16, 256, dtype=np.uint16)
SECOND = _rng.integers(0, 2**64, 256, dtype=U)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """After each byte, the sum of GEAR[byte] << age over the last 8 bytes, modulo 2**16, by doubling the window."""
    h = GEAR[raw]
    for w in (1, 2, 4):
        older = np.zeros_like(h)
        older[w:] = h[:-w]
        h = h + (older << np.uint16(w))
    return h


def steps(raw: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places where a text may be cut, never inside a character: hashes there are of this text's bytes only."""
    n = len(raw)
    inside = K.NOT_SPACE[raw]
    head = (raw & 0xC0) != 0x80
    mark = np.where(inside, 0, np.arange(n))
    mark[at[:-1][at[:-1] < n]] = at[:-1][at[:-1] < n]
    deep = np.arange(n) - np.maximum.accumulate(mark) >= LONG_WORD
    good = np.zeros(n, bool)
    good[1:] = inside[1:] & ~inside[:-1] | (hashes[:-1] >> np.uint16(16 - STEP_LOG2) == 0) & head[1:] & deep[1:]
    early = np.unique((at[:-1, None] + np.arange(GEAR_WINDOW)).ravel())
    good[early[early < n]] = False
    base = np.unique(np.concatenate((np.flatnonzero(good), at[:-1][at[:-1] < n])))
    more = np.maximum((np.diff(np.append(base, n)) - 1) // GAP, 0)
    until = at[np.searchsorted(at, base, side="right")]
    more = np.minimum(more, np.maximum((until - base - 1) // GAP, 0))
    place = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    forced = np.repeat(base, more) + GAP * place
    for _ in range(3):
        forced = forced - ~head[forced]
    good[forced] = True
    return np.flatnonzero(good)


def cuts(raw: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin of every chunk, the text it belongs to and the steps in it. Chunks begin at the last least hash of each window of a text's steps, and at the begin of a text."""
    hashes = gear_hashes(raw)
    step = steps(raw, at, hashes)
    doc = np.searchsorted(at, step, side="right") - 1
    low = hashes[step - 1].astype(np.int64) << 32 | (0xFFFFFFFF - step)
    width = 1
    while width < window and len(low):
        more = min(width, window - width)
        low = np.minimum(low[:-more], low[more:])
        width += more
    low = low[doc[: len(low)] == doc[window - 1 :][: len(low)]]
    begin = np.unique(np.concatenate((0xFFFFFFFF - (low & 0xFFFFFFFF), at[:-1])))
    begin = begin[begin < len(raw)]
    count = np.diff(np.append(np.searchsorted(step, begin), len(step)))
    return begin, np.searchsorted(at, begin, side="right") - 1, count


def _chunks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw_all, at_all = K.text_bytes(batch.column(1))
            for i, j in K.slices(at_all):
                raw, at = raw_all[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                if not len(raw):
                    continue
                begin, doc, count = cuts(raw, at, window)
                size = np.diff(np.append(begin, len(raw)))
                place = np.arange(len(raw)) - np.repeat(begin, size)
                factor = K.PLACE[place & 1023] + (place >> 10).astype(U) * U(0x9E3779B97F4A7C15)
                one = K.mixed(np.add.reduceat(K.BYTE[raw] * factor, begin) + size.astype(U))
                two = K.mixed(np.add.reduceat(SECOND[raw] * factor, begin) ^ size.astype(U))
                letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                start, end = letters[begin] - letters[at[doc]], letters[begin + size] - letters[begin]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.take(pa.array(doc + i)),
                    "place": pa.array((start << 32 | end << 8 | count).astype(np.int64)),
                    "d1": pa.array(one.view(np.int64)),
                    "d2": pa.array(two.view(np.int64)),
                })

    return run


def chunks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Chunks of docs(doc_id, text): doc_id, place (see placed), digest (d1, d2). Null and empty texts have none."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_chunks(window), "doc_id long, place long, d1 long, d2 long")


def placed(held: DataFrame) -> DataFrame:
    """What place holds in 63 bits, so that less is shuffled: start and size in code points, and steps; a chunk has fewer than 2 * WINDOW of these, each of GAP bytes at most."""
    part = lambda right, bits: F.shiftright("place", right).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return held.withColumns({"start": part(32, 31), "size": part(8, 24), "steps": part(0, 8)}).drop("place")


def repeated_spans(docs: DataFrame, least_steps: int = LEAST_STEPS) -> DataFrame:
    """Spans that other documents have too: doc_id, start, end (code points, end exclusive), n_chunks, steps, first_doc_id, is_first.

    Only chunks of two different doc_ids count, and only runs of least_steps steps or more, which is as many words where words are
    divided by blanks. Every passage of 50 words that two documents share has such a run. A run is given in spans that end where this
    document begins or ceases to be the least that has the chunks; these may be shorter. first_doc_id is the least document that
    has the span's first chunk, is_first says that the span stays here: this document is the least for all of its chunks, or for
    none of them but they are fewer than least_steps. Where it is false, others have all of it, and it may be removed. Rows without
    doc_id or text and documents without such spans give no rows; rows that repeat a doc_id count as one document. Other columns are
    not read; an empty table gives no rows."""
    every = written(chunks(docs), "chunks")  # cut and hashed once
    count = every.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("d1", "d2", "first")
    count = written(count, "chunks-shared")  # read again, so that the join may split a digest of very many chunks
    held = placed(every.join(count, ["d1", "d2"]).select("doc_id", "place", "first"))
    w = Window.partitionBy("doc_id").orderBy("start", "size")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(w) < F.col("start"), F.lit(True))
    held = held.withColumn("own", F.col("first") == F.col("doc_id")).withColumns({"fresh": fresh, "turn": F.lag("own").over(w) != F.col("own")})
    held = held.withColumns({"run": F.sum(F.col("fresh").cast("int")).over(so_far), "part": F.sum((F.col("fresh") | F.col("turn")).cast("int")).over(so_far)})
    parts = held.groupBy("doc_id", "run", "part").agg(
        F.min("start").cast("long").alias("start"),
        F.max(F.col("start") + F.col("size")).cast("long").alias("end"),
        F.count("*").alias("n_chunks"),
        F.sum("steps").alias("steps"),
        F.min_by("first", "start").alias("first_doc_id"),
        F.bool_and("own").alias("own"),
    )
    parts = parts.withColumns({"is_first": F.col("own") | (F.col("steps") < least_steps), "whole": F.sum("steps").over(Window.partitionBy("doc_id", "run"))})
    return parts.where(F.col("whole") >= least_steps).select("doc_id", "start", "end", "n_chunks", "steps", "first_doc_id", "is_first")


def deduplicated(docs: DataFrame, least_steps: int = LEAST_STEPS) -> DataFrame:
    """docs(doc_id, text, ...) with text freed of every span that a document of a smaller id has too, so each distinct passage stays in
    the least document that has it. All own columns stay, whatever their names.

    Null and empty texts and rows without doc_id stay as they are. Rows that repeat a doc_id count as one document and are cut by
    the spans of all of them where they have the same text; an id with different texts is left as it is. An empty table gives no rows."""
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    mixed = ids.agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x != y").select("doc_id")
    spans = repeated_spans(docs, least_steps).where(~F.col("is_first"))
    cut = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut")).join(mixed, "doc_id", "left_anti")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(cut, "doc_id", "left")
    text = F.col("row.text")
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    before = lambda s, x: F.substring(text, s["at"].cast("int") + 1, F.greatest(F.lit(0), x["start"] - s["at"]).cast("int"))
    free = F.aggregate("cut", none, lambda s, x: F.struct(F.concat(s["out"], before(s, x)).alias("out"), F.greatest(s["at"], x["end"]).alias("at")))
    out = rows.withColumn("free", free)
    new = F.when(F.col("cut").isNull(), text).otherwise(F.concat("free.out", F.substring(text, F.col("free.at").cast("int") + 1, F.length(text))))
    return out.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
