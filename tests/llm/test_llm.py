import random
import struct
import zlib

import numpy as np
import pytest

from crawlweave.llm import chunks, decontam, jaccard, mainhtml, packing, secrets, slots, topk, toxicity, wordpieces
from crawlweave.llm.registry import tokenizer_files

DOCS = "doc_id long, text string, score string, length int"
WORDS = "the of and that was with from over under light stone river small green bird house water field north south".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "a b c"), (4, "one"), (4, "one"), (5, "Über ÉTÉ  x\tz"), (6, "<|endoftext|> tail "), (7, prose(7, 30_000))]
    return spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    tok = Tokenizer.from_file(files[0])
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, i * 3) + "\nEnd.\nNext line", "s", 1) for i in range(60)], DOCS))
    rows = packing.pack(docs.coalesce(1), *files).collect()
    got, seqs = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(r.length for r in rows)
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in (sum(x[1] for x in s) for s in seqs.values()))
    assert padded <= 1.02 * used
    for row in docs.where("doc_id <> 4 and doc_id is not null").collect():
        ids = tok.encode(row.text or "", add_special_tokens=False).ids + [0]
        assert b"".join(x[1] for x in sorted(got[row.doc_id])) == struct.pack(f"<{len(ids)}I", *ids)
    assert packing.pack(empty(spark), *files).count() == 0


def test_repeated_spans(spark):
    shared = prose(999, 80)
    rows = [(i, prose(i, 100)) for i in range(20)] + [(50, prose(50, 60) + " " + shared + " " + prose(51, 40)), (51, "x" + prose(52, 90) + " " + shared)]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS).unionByName(odd_docs(spark))
    found = chunks.repeated_spans(docs).collect()
    assert {r.doc_id for r in found} == {50, 51}
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] in shared + " " for r in found)
    left = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    assert left[50] == text[50] and len(left[51]) < len(text[51]) - 300
    assert chunks.repeated_spans(empty(spark)).count() == 0


def test_copies_with_a_shared_opening_keep_the_rest(spark):
    """Documents 3 and 13 have the opening of the copies 5 and 9, 15 and 19 only, so the rest must stay in 5 and 15."""
    copy, other = prose(61, 200), prose(64, 200)
    rows = [(3, copy[:300] + " " + prose(62, 60)), (5, copy), (9, copy), (13, other[:90] + " " + prose(63, 60)), (15, other), (19, other)]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)
    left = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    assert left[3] == rows[0][1] and left[9] == left[19] == ""
    assert copy.endswith(left[5]) and len(copy) - 300 <= len(left[5]) < len(copy)
    assert left[15] == other


def test_fifty_short_words_are_a_passage(spark):
    """Passages of few distinct words, down to 99 bytes, each in two documents of other words around it."""
    rows = []
    for i in range(40):
        r = random.Random(i)
        few = [r.choice("abcdefghijk") * r.randint(1, 1 + i % 3) for _ in range(1 + i % 4)]
        shared = " ".join(r.choice(few) for _ in range(50))
        rows += [(2 * i + j, f"{prose(1000 + 2 * i + j, 30)} {shared} {prose(2000 + 2 * i + j, 30)}") for j in range(2)]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)
    assert {r.doc_id for r in chunks.repeated_spans(docs).collect()} == {a for a, _ in rows}


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(30)] + [(800, None), (801, [1.0, None, *[0.0] * 6]), (802, [float("nan")] * 8), (None, rows[1][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, 1024, shard=256).collect()}
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows if i is not None and i < 800}
    for q in [x for x in whole if x % 100 == 0]:
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in want]


def test_search_passes_by_all_rows_of_the_own_id():
    """A leaf with more rows of the query's id than k gives the others all the same."""
    ids = np.array([7] * 20 + [1, 2, 3, 4])
    vectors = np.array([[9]] * 20 + [[4], [3], [2], [1]])
    tree, best = topk.Tree(ids, vectors), []
    tree.search(np.array([1.0]), 7, tree.bounds(np.array([[1.0]]))[0], best, 3)
    assert sorted(best, reverse=True) == [(4, -1), (3, -2), (2, -3)]


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, k, num, den):
    rows = []
    for g in range(12):
        base = prose(g, 40 + 30 * g).split()
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[random.Random(g * 31 + c).randrange(len(w))] = f"edit{c}"
            rows.append((g * 10 + c, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, rows[0][1])]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_of_long_texts(spark, k, num, den):
    """Sizes on both sides of the first class of long sets, edits on both sides of the threshold, and texts made of few distinct words."""
    least, long = jaccard.size_classes(num, den)
    rows = []
    for g, n in enumerate([int(least[long]) - 60, int(least[long]) + 60, int(least[long + 1]) + 40, int(least[long + 3])]):
        base = prose(700 + g, n).split()
        for c in range(6):
            r, w = random.Random(g * 10 + c), list(base)
            for at in r.sample(range(n), round(n * (1 - num / den) / (2 * k) * (0.8 + 0.1 * c)) if c else 0):
                w[at] = f"edit{g}x{c}x{at}"
            rows.append((g * 10 + c, " ".join(w[: n - 7 * c])))
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)
    assert 4 < len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_similar_long_sets_share_a_slot(num, den):
    least, long = jaccard.size_classes(num, den)
    r = np.random.default_rng(5)
    for trial in range(60):
        s = long + trial % 4
        n = int(r.integers(least[s], least[s + 1]))
        one = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(r.integers(0, n * (den - num) // den))
        other = np.sort(np.delete(one, r.choice(len(one), gone, replace=False)))
        if trial % 2:  # exchanged, not only taken away
            fresh = r.integers(0, 2**64, gone, dtype=np.uint64)
            other = np.unique(np.concatenate((np.delete(one, r.choice(len(one), gone // 3, replace=False)), fresh[: gone // 4])))
        both = len(np.intersect1d(one, other))
        if den * both < num * (len(one) + len(other) - both):
            continue
        top = int(np.searchsorted(least, max(len(one), len(other)), side="right")) - 1
        for share in (0.0, 0.3, 0.95, 1.0):  # of n-grams that are frequent
            kept = [jaccard.slot_tokens(x, (x & np.uint64(1023)) >= share * 1024, top, jaccard._most_apart(least, top, num, den)) for x in (one, other)]
            assert len(np.intersect1d(*kept))


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark), 3, 90, 100).count() == 0


def test_toxicity(spark):
    bad = ["vile", "nasty", "creep"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 3]} {prose(i + 5000, 5)}" if i % 9 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(0, 900, 2)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((score[i] >= 0.3) == (i % 9 == 0) for i in held) / len(held) > 0.97
    assert toxicity.scored(odd_docs(spark), model).count() == 9
    assert toxicity.fit(empty(spark), labels.limit(0)).scores(np.zeros(0, np.int64), np.array([0, 0]))[0] < 0.3


def test_word_pieces():
    vocabulary = {bytes([i]) for i in range(256)} | {b" th", b"the", b"re", b" the", b"rein", b"in", b"ing", b"ngs", b"gs", b" a", b"ab", b"abcd", b"bc"}
    a = wordpieces.Automaton(vocabulary)
    r = random.Random(3)
    for _ in range(2000):
        w = bytes(r.choice(b"theringsabcd") for _ in range(r.randint(1, 12)))
        assert a[w] == wordpieces.brute_force(w, vocabulary)


def test_secrets_ledger(spark, tmp_path):
    from pyspark.sql import functions as F

    assert secrets.spans("é password = 'abcdef1' x") == [(2, 0, 21)]
    assert secrets.spans("secret=token:abcdefg") == []
    key = "AKIA" + "A" * 16
    assert secrets.spans("ü" + key + " " + "0a" * 12) == [(1, 1, 21), (22, 2, 46)]
    rows = [("a", 1, "token: 123456"), ("b", 1, "token: 123456"), ("c", 1, None), (None, 1, "clean")]
    ledger = f"file://{tmp_path}/ledger"
    shape = "path string, version int, text string"
    out = secrets.scan(spark.createDataFrame(rows, shape), ledger).collect()
    assert sorted((r.path or "", len(r.spans)) for r in out) == [("", 0), ("a", 1), ("b", 1), ("c", 0)]
    assert spark.read.parquet(ledger).count() == 3
    secrets.scan(spark.createDataFrame([*rows, ("d", 2, "new")], shape), ledger).collect()
    assert spark.read.parquet(ledger).count() == 4
    docs = spark.createDataFrame([(1, "x token: 123456 y", 17), (2, "z", 1)], "doc_id long, text string, n_chars long")
    found = secrets.scan(docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text"), ledger)
    done = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(docs, found.select(F.col("path").alias("doc_id"), "blob", "spans")).collect()}
    assert done == {1: ("x [SECRET] y", 12), 2: ("z", 1)}


def test_slots(spark):
    docs = spark.createDataFrame([(i, prose(i, i % 50), "s", 1) for i in range(1500)], DOCS)
    rows = slots.sharded(docs).collect()
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) <= 1.01 * min(sizes)
    load = slots.loads(slots.slotted(docs))
    old = slots.balanced(load)
    new = slots.rebalanced(old, load, 9)
    assert all(new[s] == old[s] or new[s] == 8 for s in old) and any(new[s] == 8 for s in old)
    assert slots.sharded(odd_docs(spark)).count() == 9 and slots.sharded(empty(spark)).count() == 0


def test_main_text():
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><article><header><h1>Head</h1></header><p>One &amp; two\n three<p><b>Bold.<br></p><script>var x="</p>";</script><p>As.</p><aside>side</aside><section id="comments"><p>first!</p></section></article><footer>end</footer>'
    assert mainhtml.main_text(page) == "Head\nOne & two three\nBold.\nAs."
    assert mainhtml.main_text(None) == mainhtml.main_text("") == mainhtml.main_text("<div></div>") == ""


def test_main_text_in_marked_wrappers():
    text = "A long sentence of the article that says enough. " * 5
    for name in ("content with-sidebar", "no-sidebar", "has-banner", "page-with-nav"):
        page = f'<body><div class="{name}"><article><p>{text}</p><section id="comments"><p>first!</p></section></article></div></body>'
        assert mainhtml.main_text(page) == text.strip()
        assert mainhtml.main_text(f'<body><div class="{name}"><p>{text}</p></div></body>') == text.strip()
    for name in ("related-work", "discussion", "notice"):
        page = f'<body><article><p>{text}</p><p>{text}</p><section id="{name}"><p>Kept.</p></section></article></body>'
        assert mainhtml.main_text(page).endswith("Kept.")


def test_decontamination(spark):
    items = [(1, prose(1, 30)), (2, "Short item here"), (3, None), (4, "!!"), (5, prose(1, 30)), (6, "é")]
    texts = [prose(2, 300) + " " + prose(1, 30) + " x", "so a SHORT, item--here.", prose(1, 9), prose(3, 50) + " " + " ".join(prose(1, 30).split()[5:17]), None, "", "É é", prose(4, 600)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):
        out = decontam.find_benchmark(docs, bench, chunk_bytes=size).withColumn("sha", decontam.items_digest("items")).collect()
        for r in out:
            hit = sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))
            assert (r.n_words, hit, len(r["items"]), r.sha) == decontam.brute_force(texts[r.doc_id], [x for x in items if x[1]])
    assert decontam.find_benchmark(empty(spark), bench).count() == 0
