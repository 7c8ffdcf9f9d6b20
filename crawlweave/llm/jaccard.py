"""N-gram Jaccard join by vertical partitioning.

The global n-gram order (rare first, by a sketch of document frequencies over all texts, then by hash) is cut into fragments.
Texts meet on the n-grams that the order's prefix bound allows; long texts, whose prefixes hold many n-grams of chance, meet on whole
slots of the hash order instead, more slots than similar texts may differ in n-grams. Each fragment of a pair counts its partial overlap
by itself and the counts are summed per pair. A bucket of texts that share an n-gram is not expanded into pairs. First every member is
compared with the bucket's least member. In large buckets each component then tests one pair a round, the one whose parities differ least,
so families whose members link grow together in work that is linear in the rows. Only what is still in different components afterwards is paired,
after size and parity bounds that lose no link: in buckets of bounded size directly, in large ones by blocks of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm import kernels as K
from crawlweave.runtime import dropped, measured, released, small, written

U = np.uint64
SLOTS_LOG2, PARTS = 18, 64
#: Bits of a text's parity sketch, and of the wide one of texts of more n-grams.
SKETCH_BITS = 512
WIDE_BITS, WIDE_FROM = 8192, 250
#: Rows of a large bucket, of the parts that it is dealt into in a round, and of a bucket's block in the last pass; rounds at most.
LARGE_BUCKET, PART_ROWS, BLOCK_ROWS, ROUNDS = 32, 256, 4096, 5
#: Rounds end when one has linked fewer pairs than the rows of large buckets by this; the last pass does the rest.
ROUND_GAIN = 200
#: Edges that one task may unite (16 bytes each).
ONE_TASK = 200_000
FRAGMENTS_LOG2 = 2


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Levels of a count-min row of 2**18 counters over every text's n-gram set: 0 for usual counts, more for frequent ones."""
    from pyspark import TaskContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS_LOG2, np.int64)
        for batch in batches:
            raw, at = K.text_bytes(batch.column(0))
            for i, j in K.slices(at):
                g, _ = K.shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
                total += np.bincount((g >> U(64 - SLOTS_LOG2)).astype(np.int64), minlength=len(total))
        task = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "lane": pa.array([task] * PARTS, pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, PARTS)], pa.binary())})

    def add(pdf):
        out = pdf.iloc[:1].copy()
        out["counts"] = [sum(np.frombuffer(x, np.int64) for x in pdf["counts"]).tobytes()]
        return out

    shape = "part int, lane int, counts binary"
    lanes = docs.select("text").mapInArrow(released(count), shape).groupBy("part", "lane").applyInPandas(add, shape)
    rows = lanes.groupBy("part").applyInPandas(add, shape).collect()  # 64 rows of 32 KB, whatever the input
    if not rows:
        return np.zeros(1 << SLOTS_LOG2, np.uint8)
    total = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])])
    usual = 2 * total.mean() + 16
    return np.where(total <= usual, 0, np.log2(np.maximum(total / usual, 1)).astype(int) + 1).clip(0, 60).astype(np.uint8)


def size_classes(num: int, den: int) -> tuple[np.ndarray, int]:
    """Least sizes of classes of which a set's partners are in the same or an adjacent one, and the first class of long sets.

    Sets are long where similar ones may differ in three eighths of a sketch's bits, so that it hardly tells any two apart."""
    least = [1]
    while num < den and least[-1] < 1 << 34:
        least.append(least[-1] * den // num + 1)
    long = next((s for s in range(len(least) - 1) if _most_apart(least, s, num, den) >= SKETCH_BITS * 3 // 8), len(least))
    return np.array(least, np.int64), long


def _most_apart(least, s: int, num: int, den: int) -> int:
    """How many n-grams may be in just one of two similar sets, the larger of them in class s."""
    return int(2 * (least[s + 1] - 1) * (den - num) // (den + num))


def slot_tokens(grams: np.ndarray, usual: np.ndarray, s: int, apart: int) -> np.ndarray:
    """Digests of a long set's slots in the scheme of class s: ranges of the hash order, more than the `apart` n-grams that may differ.

    A differing n-gram changes one slot, so similar sets share a slot's content, one with n-grams if either set fills more than `apart`
    slots. Frequent n-grams are left out; a set that then fills too few slots also gives its slots with them, and if those are too few
    too, the empty ones as well. Two such sets give both kinds, so they still meet."""
    slots = apart + apart // 8 + 8

    def digests(own: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        salt = K.mixed(np.arange(slots, dtype=U) + U((2 * s + kind) << 40))
        slot = ((own >> U(32)) * U(slots) >> U(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        sums = np.add.reduceat(K.mixed(own ^ U(0x2545F4914F6CDD1D)), begin) if len(begin) else own[:0]
        return K.mixed(sums + salt[slot[begin]]), slot[begin], salt

    out, _, _ = digests(grams[usual], 0)
    if len(out) <= apart:
        whole, filled, salt = digests(grams, 1)
        empty = K.mixed(np.delete(salt, filled)) if len(whole) <= apart else whole[:0]
        out = np.concatenate((out, whole, empty))
    return out


def _profile(k: int, num: int, den: int, levels):
    """Per text: size and digest of its n-gram set, a parity sketch, and its tokens: the prefix of the set in the global order, or slots."""
    least, long = size_classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            raw, at = K.text_bytes(batch.column(1))
            for i, j in K.slices(at):
                g, ends = K.shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
                n = np.diff(ends)
                docs = np.repeat(np.arange(j - i), n)
                node = K.mixed(K.sums(K.mixed(g ^ U(0x2545F4914F6CDD1D)), ends) + n.astype(U))
                bits = np.bincount(docs * SKETCH_BITS + (g & U(SKETCH_BITS - 1)).astype(np.int64), minlength=(j - i) * SKETCH_BITS) & 1
                sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
                wide = [None if n[d] <= WIDE_FROM else np.packbits((np.bincount((g[ends[d] : ends[d + 1]] & U(WIDE_BITS - 1)).astype(np.int64), minlength=WIDE_BITS) & 1).astype(np.uint8)).view(np.int64) for d in range(j - i)]
                order = np.argsort((docs << 6) | level[(g >> U(64 - SLOTS_LOG2)).astype(np.int64)], kind="stable")
                grade = np.searchsorted(least, n, side="right") - 1
                size = np.where((n > 0) & (grade < long), n - (num * n + den - 1) // den + 1, 0)
                place = np.arange(len(g)) - np.repeat(ends[:-1], n)
                tokens = g[order][place < np.repeat(size, n)].view(np.int64)
                if len(lengthy := np.flatnonzero(grade >= long - 1)):
                    pieces = np.split(tokens, np.cumsum(size)[:-1])
                    for d in lengthy.tolist():
                        own = g[ends[d] : ends[d + 1]]
                        usual = level[(own >> U(64 - SLOTS_LOG2)).astype(np.int64)] == 0
                        for c in range(max(int(grade[d]), long), int(grade[d]) + 2):
                            pieces[d] = np.concatenate((pieces[d], slot_tokens(own, usual, c, _most_apart(least, c, num, den)).view(np.int64)))
                    tokens, size = np.concatenate(pieces), np.array([len(x) for x in pieces])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i).cast(pa.int64()),
                    "n": pa.array(n.astype(np.int64)),
                    "node": pa.array(node.view(np.int64), mask=n == 0),
                    "sketch": pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * 8, 8, dtype=np.int32)), pa.array(sketch)),
                    "wide": pa.array(wide, pa.list_(pa.int64())),
                    "tokens": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(tokens)),
                })

    return run


def _segments(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.text_bytes(batch.column(0))
            for i, j in K.slices(at):
                g, ends = K.shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k)
                node = K.mixed(K.sums(K.mixed(g ^ U(0x2545F4914F6CDD1D)), ends) + np.diff(ends).astype(U)).view(np.int64)
                rows: dict = {"node": [], "frag": [], "grams": []}
                for d in range(j - i):
                    own = g[ends[d] : ends[d + 1]]
                    cut = np.searchsorted(own >> U(64 - FRAGMENTS_LOG2), np.arange((1 << FRAGMENTS_LOG2) + 1, dtype=U))
                    for f, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                        if y > x:
                            rows["node"].append(int(node[d]))
                            rows["frag"].append(f)
                            rows["grams"].append(_packed(own[x:y]))
                yield pa.RecordBatch.from_pydict({"node": pa.array(rows["node"], pa.int64()), "frag": pa.array(rows["frag"], pa.int32()), "grams": pa.array(rows["grams"], pa.binary())})

    return run


def _packed(grams: np.ndarray) -> bytes:
    """The 40 bits after a fragment's own 2 of each n-gram hash, five bytes each: sets travel, so they travel small."""
    return np.ascontiguousarray(((grams << U(FRAGMENTS_LOG2)) >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(U).ravel()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        both, was, own = [], None, None
        for p, q in zip(x, y, strict=True):
            if (now := p.as_py()) != was:
                was, own = now, _unpacked(now)
            both.append(len(np.intersect1d(own, _unpacked(q.as_py()))))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "frag": batch.column("frag"), "overlap": pa.array(both, pa.int64())})


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Written pairs (a, b) of nodes whose sets are similar enough: each fragment's overlap is counted by itself, then summed.

    The texts behind the pairs are read and cut once; a set is shuffled once as a pair's `a`, whatever the number of its pairs, and
    once for each pair as `b`."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = written(nodes.join(classes.select("node", F.col("rep").alias("doc_id")), "node").select("doc_id").distinct(), "join-ids")
    rows = docs.join(small(reps), "doc_id", "left_semi").select("text").mapInArrow(released(_segments(k)), "node long, frag int, grams binary")
    sets = written(rows, "join-sets")
    hubs = sets.select(F.col("node").alias("a"), "frag", F.col("grams").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    others = sets.select(F.col("node").alias("b"), "frag", F.col("grams").alias("y")).join(small(pairs), "b")
    met = others.join(hubs, ["a", "frag"]).select("a", "b", "frag", "x", "y")
    part = met.mapInArrow(released(_overlaps), "a long, b long, frag int, overlap long").groupBy("a", "b", "frag").agg(F.max("overlap").alias("overlap"))  # rows may repeat
    total = part.groupBy("a", "b").agg(F.sum("overlap").alias("both"))
    size = classes.select("node", "n")
    total = total.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    found = written(total.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b"), "join-links")
    dropped(reps, sets)
    return found


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Drops pairs that sizes or parities rule out: differing parity bits never outnumber differing n-grams."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num))).select("a", "b")


def _narrowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Written pairs (a, b) without those of texts that wide sketches rule out."""
    both = written(pairs, "join-candidates")
    held = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wide = written(classes.where("wide is not null").select("node", "n", "wide").join(held, "node", "left_semi"), "join-wide")
    one = small(wide)
    side = lambda x: one.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    near = both.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    far = (apart * (num + den) > (F.col("na") + F.col("nb")) * (den - num)) & F.col("wa").isNotNull() & F.col("wb").isNotNull()
    out = written(near.where(~F.coalesce(far, F.lit(False))).select("a", "b"), "join-pairs")
    dropped(both, wide)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole groups, from rows sorted by the keys, and where each group begins, with the end. A group is held whole."""
    kept = None

    def opened(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        columns = {}
        for name in t.column_names:
            c = t.column(name).combine_chunks()
            columns[name] = c.flatten().to_numpy().view(U).reshape(t.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([columns[k][1:] != columns[k][:-1] for k in keys])
        return columns, np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        kept = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
        last = np.logical_and.reduce([np.asarray(kept.column(k)) == kept.column(k)[-1].as_py() for k in keys])
        first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if first:
            yield opened(kept.slice(0, first))
            kept = kept.slice(first)
    if kept is not None and kept.num_rows:
        yield opened(kept)


class _Pairs:
    """Distinct pairs, given away in batches whenever many have come together."""

    def __init__(self, most: int = 1 << 20):
        self.held, self.size, self.most = [], 0, most

    def add(self, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(x):
            self.held.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1))
            self.size += len(x)
        if self.size >= self.most:
            self.held = [np.unique(np.concatenate(self.held), axis=0)]
            self.size = len(self.held[0])
            if 2 * self.size >= self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            out = np.unique(np.concatenate(self.held), axis=0)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])


def _small_pairs(num: int, den: int):
    """Pairs of different components in buckets of bounded size that sizes and parities allow. Rows are sorted by bucket and size; all buckets advance together by the distance in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs()
        for c, _ in _groups(batches, ["sig"]):
            sig, node, comp, n, sketch = (c[k] for k in ("sig", "node", "comp", "n", "sketch"))
            active, step = np.arange(len(sig)), 0
            while len(active):
                step += 1
                active = active[active + step < len(sig)]
                near = (sig[active] == sig[active + step]) & (n[active] * den >= n[active + step] * num)
                active = active[near]
                x, y = active, active + step
                ask = comp[x] != comp[y]
                x, y = x[ask], y[ask]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                ok = apart * (num + den) <= (n[x] + n[y]) * (den - num)
                yield from out.add(node[x[ok]], node[y[ok]])
        yield from out.rest()

    return run


def _nearest(num: int, den: int, each: int = 3):
    """For every component in a bounded part of a large bucket, its pairs of fewest differing parities with other components: comp, apart, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, bounds in _groups(batches, ["sig", "part"]):
            rows = []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                comp, n, sketch, node = (c[k][i:j] for k in ("comp", "n", "sketch", "node"))
                if (comp == comp[0]).all():
                    continue
                apart = np.bitwise_count(sketch[:, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int32)
                no = (comp[:, None] == comp[None, :]) | (np.minimum.outer(n, n) * den < np.maximum.outer(n, n) * num) | (apart * (num + den) > np.add.outer(n, n) * (den - num))
                apart[no] = SKETCH_BITS + 1
                best = np.argsort(apart, axis=1, kind="stable")[:, :each]
                x, y = np.repeat(np.arange(j - i), best.shape[1]), best.ravel()
                d = apart[x, y]
                ok = d <= SKETCH_BITS
                x, y, d = x[ok], y[ok], d[ok]
                order = np.lexsort((d, comp[x]))
                x, y, d = x[order], y[order], d[order]
                begin = np.searchsorted(comp[x], comp[x])
                some = np.arange(len(x)) - begin < each
                x, y, d = x[some], y[some], d[some]
                rows.append((comp[x], d.astype(np.int64), np.minimum(node[x], node[y]), np.maximum(node[x], node[y])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r), pa.int64()) for r in zip(*rows, strict=True)], names=["comp", "apart", "a", "b"])

    return run


def _block_pairs(num: int, den: int):
    """Pairs of different components in large buckets that sizes and parities allow. A task has all rows of two blocks of nodes, so it gives a pair once, however many buckets hold it; rows of a bucket's largest component are never compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs()
        for c, bounds in _groups(batches, ["i", "j", "sig"]):
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                comp, n, sketch, node, block = (c[k][p:q] for k in ("comp", "n", "sketch", "node", "block"))
                two = c["i"][p] != c["j"][p]
                names, count = np.unique(comp, return_counts=True)
                few = np.flatnonzero(comp != names[np.argmax(count)])
                for r in few.tolist():
                    good = (comp != comp[r]) & (np.minimum(n, n[r]) * den >= np.maximum(n, n[r]) * num)
                    if two:
                        good &= block != block[r]
                    y = np.flatnonzero(good)
                    apart = np.bitwise_count(sketch[y] ^ sketch[r]).sum(axis=1, dtype=np.int64)
                    y = y[apart * (num + den) <= (n[y] + n[r]) * (den - num)]
                    yield from out.add(np.full(len(y), node[r]), node[y])
        yield from out.rest()

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each component, by labels that jump to their labels' labels."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    nodes, ends = np.unique(np.concatenate((t.column(0).to_numpy(), t.column(1).to_numpy())), return_inverse=True)
    u, v = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        was = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == was).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Written (node, label) of every node in edges(a, b); a label is the least node of its component.

    Few edges, counted first, are united by one task; more go through large and small stars, of which each round is written. Groups
    are only ever reduced to a minimum and joined back, so a node with very many edges is never collected."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "join-edges")
    mark = state(now)
    if mark[0] <= one_task:
        out = written(now.coalesce(1).mapInArrow(released(_united), "node long, label long"), "join-labels")
        dropped(now)
        return out
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = least(both).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mins = least(large)
        star = large.join(mins, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        old, now = now, written(star.where("u != v").distinct(), "join-edges")
        dropped(old)
        was, mark = mark, state(now)
        if was == mark:
            break
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "join-labels")
    dropped(now)
    return out


class _Join:
    """What the rounds share: links found so far, labels by them, pairs that have been compared."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int):
        self.docs, self.classes, self.words, self.num, self.den = docs, classes, words, num, den
        self.labels: DataFrame | None = None
        self.tested: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")

    def test(self, pairs: DataFrame) -> int:
        """Compares pairs(a, b) of nodes in different components and unites what is linked; how many pairs were linked."""
        pairs = _narrowed(pairs, self.classes, self.num, self.den)
        links = _verified(pairs, self.docs, self.classes, self.words, self.num, self.den) if pairs.head(1) else pairs.limit(0)
        if self.tested is None:
            self.tested, found = pairs, links.count()
            self.labels = components(links)
        else:
            tested = written(self.tested.unionByName(pairs), "join-tested")
            dropped(self.tested, pairs)
            self.tested, found = tested, links.count()
            if found:
                ends = self.labelled(self.labelled(links.withColumnRenamed("a", "node")).select(F.col("comp").alias("a"), F.col("b").alias("node"))).select("a", F.col("comp").alias("b"))
                more = components(ends)  # of components by their labels
                named = self.labels.join(more.toDF("label", "newer"), "label", "left").select("node", F.coalesce("newer", "label").alias("label"))
                fresh = more.join(self.labels.select("node"), "node", "left_anti")
                labels = written(named.unionByName(fresh), "join-labels")
                dropped(self.labels, more)
                self.labels = labels
        dropped(links)
        return found


def _rounds(join: _Join, large: DataFrame, most: int) -> DataFrame:
    """Lets components in large buckets find each other: in every round each tests one pair, that of the fewest differing parities which it
    meets in parts of the buckets that are dealt anew. Work and output grow with the rows. Returns the written rows of buckets that are still mixed."""
    part = large
    for turn in range(most + 1):
        named = join.labelled(part.select("sig", "node", "n", "sketch"))
        count = named.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("sig", "m")
        now = written(named.join(count, "sig"), "join-large")
        dropped(part)
        part = now
        if turn == most or not part.head(1):
            break
        parts = F.ceil(F.col("m") / PART_ROWS)
        dealt = part.withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), parts).cast("long")).drop("m")
        dealt = dealt.repartition("sig", "part").sortWithinPartitions("sig", "part").select("sig", "part", "node", "comp", "n", "sketch")
        asked = dealt.mapInArrow(released(_nearest(join.num, join.den)), "comp long, apart long, a long, b long")
        asked = asked.groupBy("a", "b", "comp").agg(F.min("apart").alias("apart")).join(join.tested, ["a", "b"], "left_anti")
        asked = asked.groupBy("comp").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        if ROUND_GAIN * join.test(asked) < measured(part)[0]:
            break
    return part


def jaccard_components(docs: DataFrame, words: int, num: int, den: int, large_bucket: int = LARGE_BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text); texts link when den * both >= num * either.

    Empty and null texts have no n-grams, are linked with nothing and are their own component. A null doc_id is counted but takes
    no part in links; its component is null. Rows that repeat a doc_id stay rows; the id stands for all of them. Other columns are
    not read. An empty table gives no rows. large_bucket and rounds change the plan, never the result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(_frequencies(docs, words))  # 256 KB, whatever the input
    profile = written(docs.mapInArrow(released(_profile(words, num, den, levels)), "doc_id long, n long, node long, sketch array<long>, wide array<long>, tokens array<long>"), "join-profile")
    levels.unpersist()
    part = profile.where("node is not null and doc_id is not null")
    ids = written(profile.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "join-ids")
    classes = written(part.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "join-classes")

    each = part.select(F.explode("tokens").alias("sig"), "node")
    shared = written(each.groupBy("sig").agg(F.min("node").alias("center"), F.max("node").alias("most")).where("center != most").select("sig", "center"), "join-shared")
    members = written(each.join(shared, "sig").distinct(), "join-members")
    dropped(profile, shared)

    join = _Join(docs, classes, words, num, den)
    first = members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    join.test(_bounded(first, classes, num, den).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))  # one comparison each; what follows misses none

    sizes = written(members.groupBy("sig").agg(F.count("*").alias("m")).where(F.col("m") > large_bucket).select("sig"), "join-sizes")
    beyond = small(sizes)
    large = written(members.select("sig", "node").join(beyond, "sig", "left_semi").join(classes.select("node", "n", "sketch"), "node"), "join-large")
    large = _rounds(join, large, rounds)

    named = join.labelled(members.select("sig", "node").join(beyond, "sig", "left_anti"))
    split = named.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("sig")
    mixed = named.join(split, "sig").join(classes.select("node", "n", "sketch"), "node")
    mixed = mixed.repartition("sig").sortWithinPartitions("sig", "n").select("sig", "node", "comp", "n", "sketch")
    rest = mixed.mapInArrow(released(_small_pairs(num, den)), "a long, b long")
    if top := large.agg(F.max("m")).first()[0] if "m" in large.columns else None:
        blocks = max(4, -(-top // BLOCK_ROWS))
        left = join.labelled(large.select("sig", "node", "n", "sketch")).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.lit(blocks)).cast("long"))
        left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        left = left.repartition("i", "j").sortWithinPartitions("i", "j", "sig").select("i", "j", "sig", "block", "node", "comp", "n", "sketch")
        rest = rest.unionByName(left.mapInArrow(released(_block_pairs(num, den)), "a long, b long"))
    join.test(rest.distinct().join(join.tested, ["a", "b"], "left_anti"))
    dropped(members, large, sizes, join.tested)

    own = join.labelled(classes.select("node", "rep"))
    least = own.groupBy("comp").agg(F.min("rep").alias("component_id"))
    where = own.join(least, "comp").select("node", "component_id")
    found = ids.join(where, "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
