"""Chunk dedup against brute force: each distinct passage survives once, shared passages are found."""

import random

import pytest
from test_llm import DOCS, WORDS, empty, odd_docs, prose

from crawlweave.llm import chunks


def shingles(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_each_distinct_passage_survives_once(spark):
    a, b, c = prose(1, 150), prose(2, 150), prose(3, 150)
    rows = [(1, a), (5, a + " " + b), (9, " ".join(a.split()[-60:]) + " " + b), (11, b + " " + c), (12, c + " " + a), (13, c), (20, prose(9, 400)), (21, " ".join(prose(9, 400).split()[100:300]))]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)
    left = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    before, after = (set().union(*(shingles(t, 2) for t in texts)) for texts in (dict(rows).values(), left.values()))
    # pairs of words across a cut may go, all others must stay somewhere
    inner = set().union(*(shingles(x, 2) for x in (a, b, c, prose(9, 400))))
    lost = (before & inner) - after
    assert len(lost) <= 12, lost
    assert sum(map(len, left.values())) < 0.75 * sum(len(t) for _, t in rows)
    assert left[1] == a and left[13] == ""


@pytest.mark.parametrize("unit", ["the ", "a b ", "x", "字", "ab"])
def test_periodic_passages_are_found(spark, unit):
    shared = unit * (3000 // len(unit))
    rows = [(1, prose(1, 40) + " " + shared + " " + prose(2, 30)), (2, prose(3, 25) + " " + shared), (3, prose(4, 100))]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)
    assert {r.doc_id for r in chunks.repeated_spans(docs).collect()} == {1, 2}


def test_shared_passages_as_brute_force_finds_them(spark):
    """Documents that share 50 words are all found; documents that share no 12 words are not."""
    r = random.Random(8)
    passages = [" ".join(r.choice(WORDS) + r.choice(["", "s", str(r.randint(0, 999))]) for _ in range(n)) for n in (50, 55, 80, 200)]
    rows = []
    for i in range(120):
        mid = r.choice(passages) if i % 3 else ""
        rows.append((i, f"{prose(100 + i, r.randint(0, 80))} {mid} {prose(300 + i, r.randint(0, 80))}".strip()))
    sets50, sets12 = ({i: shingles(t, k) for i, t in rows} for k in (50, 12))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)
    found = {x.doc_id for x in chunks.repeated_spans(docs).collect()}
    assert {i for i, _ in rows if any(sets50[i] & sets50[j] for j, _ in rows if j != i)} <= found
    assert not {i for i, _ in rows if not any(sets12[i] & sets12[j] for j, _ in rows if j != i)} & found


def test_odd_rows(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(50, prose(7, 30_000), "t", 2), (50, prose(7, 30_000), "t", 2), (60, prose(7, 200), "t", 2), (60, prose(8, 200), "u", 3)], DOCS))
    left = chunks.deduplicated(docs).collect()
    assert len(left) == docs.count() and docs.columns == chunks.deduplicated(docs).columns
    texts = {(r.doc_id, r.score): r.text for r in left}
    assert texts[1, "s"] is None and texts[2, "s"] == "" and texts[50, "t"] == "" and texts[60, "u"] == prose(8, 200) and texts[60, "t"] == prose(7, 200)
    clash = docs.withColumnRenamed("score", "cut").withColumnRenamed("length", "row")
    assert chunks.deduplicated(clash).columns == clash.columns
    assert chunks.deduplicated(empty(spark)).count() == 0


def test_insertions_move_few_chunks():
    import numpy as np

    text = prose(5, 5000)
    words = text.split()
    other = " ".join([*words[:1000], "inserted", *words[1000:]])
    sets = []
    for t in (text, other):
        raw = np.frombuffer(t.encode(), np.uint8)
        begin, _, _ = chunks.cuts(raw, np.array([0, len(raw)]))
        sets.append({t.encode()[x:y] for x, y in zip(begin, [*begin[1:], len(raw)], strict=True)})
    assert len(sets[0] ^ sets[1]) <= 6
