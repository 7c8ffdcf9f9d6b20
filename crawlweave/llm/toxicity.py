"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of any row the unlabelled; labels of 0 are never read as negatives, only the share
of toxic rows among labelled ones, which is the class prior. The classifier is linear over words, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm import kernels as K
from crawlweave.runtime import dropped, released, written

#: Bounds of the training sample: positive and unlabelled texts.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Words of a model at most, and those that enter however few texts there are.
MOST_WORDS, LEAST_WORDS = 2_000, 16
#: What a word must show to enter: standard errors, times the unlabelled rate. Weight of the penalty on weights.
#: Chosen by three folds inside the rows outside the held-out one: tests/llm/toxicity_folds.py.
LEAST_Z, LEAST_RATIO, DECAY = 3, 2, 1e-4
HELD_OUT = (4, 2)
THRESHOLD = 0.3


def held_out(doc_id):
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


#: Least hashes that stand for a text when near copies are looked for, and how many in a row make a band.
LOWS, BAND = 18, 3


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: whether it is a positive, its id, the set of its words' hashes, and bands of that set's least hashes (none if it has no words)."""
    for batch in batches:
        raw, at = K.text_bytes(batch.column(2))
        for i, j in K.slices(at):
            g, ends = K.shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], 1, K.ALNUM)
            bands = []
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                lows = np.array([K.mixed(g[x:y] ^ K.PLACE[n]).min() for n in range(LOWS)]) if y > x else g[:0]
                bands.append([int(K.mixed(K.mixed(lows[n : n + BAND] + np.arange(n, n + BAND, dtype=np.uint64)).sum(keepdims=True)).view(np.int64)[0]) for n in range(0, len(lows), BAND)])
            words = pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), pa.array(g.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), words, pa.array(bands, pa.list_(pa.int64()))], names=["positive", "row", "words", "bands"])


def _without_copies(bands: list[list[int]]) -> list[int]:
    """Places of one of each group of near copies, so that a text that was copied does not pass its own words off as toxic ones."""
    seen: set[int] = set()
    out = []
    for i, own in enumerate(bands):
        if own and seen.isdisjoint(own):
            out.append(i)
        seen.update(own)
    return out


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], bias

    def scores(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of sets of word hashes, flat, with their bounds."""
        z = np.full(len(ends) - 1, self.bias)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            np.add.at(z, np.searchsorted(ends, hit, side="right") - 1, self.weights[at[hit]])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def telling(words: np.ndarray, count: np.ndarray, base: np.ndarray, positives: int, unlabelled: int, most: int = MOST_WORDS) -> np.ndarray:
    """Ascending words that positives (in `count` of them) have more often than unlabelled texts (`base`), beyond chance."""
    p, u = count / positives, (base + 0.5) / (unlabelled + 1)
    pool = (count + base) / (positives + unlabelled)
    z = (p - u) / (np.sqrt(pool * (1 - pool) * (1 / positives + 1 / unlabelled)) + 1e-9)
    # the chance of as many by the unlabelled rate: a Poisson tail's first term
    tail = np.exp(count * np.log(positives * u) - positives * u - np.array([math.lgamma(c + 1) for c in count]))
    rank = np.argsort(np.argsort(-z, kind="stable"))
    good = (z > LEAST_Z) & (p > LEAST_RATIO * u) & ((tail * len(words) < 1) | (rank < LEAST_WORDS))
    return np.sort(words[good][np.argsort(-z[good], kind="stable")[:most]])


def train(words: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = DECAY) -> Model:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the logistic loss, by Adam.

    positive and unlabelled hold a row of packed bits for each text: which of the words it has; equal rows are taken together. Where the
    estimate in the second term is negative, that term is held at 0 and only the first one is followed. The bias is the share of toxic
    texts among those without any such word, which the class prior gives."""
    if not len(positive) or not len(unlabelled) or not len(words) or not 0 < prior < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), -60.0)

    def matrix(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, times = np.unique(packed, axis=0, return_counts=True)
        return np.unpackbits(rows, axis=1)[:, : len(words)].astype(np.float32), times / len(packed)

    (xp, sp), (xu, su) = matrix(positive), matrix(unlabelled)
    none = prior * (sp[xp.sum(axis=1) == 0].sum() + 0.5 / len(positive)) / (su[xu.sum(axis=1) == 0].sum() + 0.5 / len(unlabelled))
    none = float(np.clip(none, 1e-4, prior))  # the share of toxic texts among those that have none of the words
    w, b = np.zeros(len(words)), np.log(none / (1 - none))
    m, v = np.zeros(len(words)), np.zeros(len(words))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, rounds + 1):
        zp, zu = xp @ w + b, xu @ w + b
        negative = su @ np.logaddexp(0, zu) - prior * (sp @ np.logaddexp(0, zp))
        up, uu = sigmoid(zp), sigmoid(zu)
        gp = prior * sp * (up - 1)  # gradient of prior * mean(log(1 + exp(-z)))
        g = xp.T @ (gp - prior * sp * up) + xu.T @ (su * uu) if negative >= 0 else xp.T @ gp
        g = g + decay * w * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), 0)
    keep = w > 0.05
    return Model(words[keep], w[keep], float(b))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from at most `positives` confirmed toxic texts outside the held-out fold and about `unlabelled` texts of any row.

    Words are counted by executors; the driver gets the bands of the positives, the counts of the words that differ most, and for
    each sampled text one bit for each word chosen, so what it holds is bounded however long texts are. Rows without doc_id are never
    positives; null texts have no words; labels that repeat or are null, and documents that repeat, count as they stand in the
    sample. Without positives or without texts the model has no words and scores about 0. Other columns are not read."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -60.0)
    if not prior or prior >= 1:
        return nothing
    ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    share = min(1.0, unlabelled / max(1, docs.count()))
    some = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    taken = rows.join(F.broadcast(ids), "doc_id", "left_semi").limit(2 * positives).select(F.lit(True).alias("positive"), F.xxhash64("doc_id", "text").alias("row"), "text")
    taken = taken.unionByName(some.select(F.lit(False).alias("positive"), F.lit(0).cast("long").alias("row"), "text"))
    sets = written(taken.mapInArrow(released(_word_sets), "positive boolean, row long, words array<long>, bands array<long>"), "toxic-sample")
    known_rows = sets.where("positive").select("row", "bands").orderBy("row").collect()  # bounded by the sample
    kept = [known_rows[i]["row"] for i in _without_copies([r["bands"] for r in known_rows])]
    others = sets.where("not positive").count()
    if not kept or not others:
        dropped(sets)
        return nothing
    mine = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in kept], "row long"))  # bounded by the sample
    chosen = sets.where("positive").join(mine, "row", "left_semi").dropDuplicates(["row"]).select("positive", "words").unionByName(sets.where("not positive").select("positive", "words"))
    n = len(set(kept))
    each = chosen.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("count"), F.count_if(~F.col("positive")).alias("base"))
    p, u, pool = F.col("count") / n, (F.col("base") + 0.5) / (others + 1), (F.col("count") + F.col("base")) / (n + others)
    z = (p - u) / F.sqrt(pool * (1 - pool) * (1 / n + 1 / others) + 1e-18)
    top = each.where("count >= 2").orderBy(z.desc(), "word").limit(4 * MOST_WORDS).collect()
    words, count, base = (np.array([r[i] for r in top], np.int64) for i in range(3))
    words = telling(words, count, base, n, others) if len(words) else words

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.packbits(np.isin(words, x.values.to_numpy())).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["positive", "bits"])

    held = chosen.mapInArrow(released(bits), "positive boolean, bits binary").collect() if len(words) else []  # 250 bytes for each sampled text
    dropped(sets)
    packed = [np.frombuffer(b"".join(r["bits"] for r in held if r["positive"] == x), np.uint8).reshape(-1, (len(words) + 7) // 8) if len(words) else np.zeros((0, 0), np.uint8) for x in (True, False)]
    return train(words, *packed, prior)


def _score(texts: pa.Array, model: Model) -> np.ndarray:
    raw, at = K.text_bytes(texts)
    out = np.zeros(len(texts))
    known = model.words
    for i, j in K.slices(at):
        w = K.Words(raw[at[i] : at[j]], at[i : j + 1] - at[i], K.ALNUM)
        h = K.single(w.hashes()).view(np.int64)
        pair = np.zeros((2, 0), np.int64)
        if len(known):
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            pair = np.unique(np.stack([w.doc[hit], h[hit]]), axis=1)  # each word once per text
        out[i:j] = model.scores(pair[1], np.searchsorted(pair[0], np.arange(j - i + 1)))
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of docs(doc_id, text), over whole texts. Null and empty texts have the score of no words.

    Rows stay as they are, repeated or without doc_id; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2,000 words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(batch.column(1), sent.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs(text, ...) that score below the threshold, with all their columns, whatever their names. Null and empty texts have
    the score of no words; repeated rows stay or go together; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch.column(at_text), sent.value) < threshold))

    return docs.mapInArrow(released(run), docs.schema)
