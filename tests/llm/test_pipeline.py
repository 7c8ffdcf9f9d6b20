"""The stages and run() against brute force on a small corpus, with columns whose names clash."""

import random
import struct

from test_llm import brute_components, prose

from crawlweave.llm import decontam, secrets, toxicity
from crawlweave.llm.registry import tokenizer_files

COLUMNS = "doc_id long, text string, spans string, n_words int, row string, n_chars long"


def masked(text):
    out, at = "", 0
    for a, _, b in secrets.spans(text or ""):
        if a >= at:
            out += (text[at:a]) + "[SECRET]"
        at = max(at, b)
    return text if text is None or not secrets.spans(text) else out + text[at:]


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    r = random.Random(4)
    bench = [(1, prose(900, 40)), (2, "Short item here")]
    rows = []
    for i in range(160):
        text = prose(i, r.randint(30, 90))
        if i % 8 == 0:
            text += " vile creep " + prose(i + 500, 5)
        if i % 10 == 3:
            text = rows[-2][1].replace(" ", "  ", 1) if i % 20 == 3 else rows[-1][1] + " tail"
        if i % 17 == 5:
            text += " " + " ".join(prose(900, 40).split()[4:20])
        if i % 23 == 7:
            text += " password = 'abc" + str(i) + "def' end"
        rows.append((i, text))
    rows += [(160, None), (161, ""), (None, "no id " + prose(7000, 20)), (162, rows[1][1]), (163, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "mine", 7, "own", len(t or "")) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 160, 2)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    read = spark.read.parquet(f"{sf}/documents.parquet")

    def kept(df):
        got = df.collect()
        assert df.columns == docs.columns and all((x.spans, x.n_words, x.row) == ("mine", 7, "own") for x in got)
        return sorted(((x.doc_id if x.doc_id is not None else -1), x.text or "", x.text is None) for x in got), df

    def expected(items):
        return sorted((i if i is not None else -1, t or "", t is None) for i, t in items)

    one, df = kept(P.drop_toxic(spark, read, sf))
    model = toxicity.fit(read, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {(x.doc_id, x.text) for x in read.join(toxicity.scored(read, model).where("score >= 0.3").select("doc_id").distinct(), "doc_id").collect()}
    left = [(i, t) for i, t in rows if (i, t) not in bad]
    assert one == expected(left)
    groups = brute_components([x for x in left if x[0] is not None], 5, 80, 100)
    left = [(i, t) for i, t in left if i is None or groups[i][1] == i]
    two, df = kept(P.one_of_near_copies(spark, df, sf))
    assert two == expected(left) and len(two) < len(one)
    left = [(i, t) for i, t in left if decontam.brute_force(t, bench)[1] == 0]
    three, df = kept(P.drop_leaks(spark, df, sf))
    assert three == expected(left) and len(three) < len(two)
    left = [(i, masked(t)) for i, t in left]
    four, df = kept(P.mask_secrets(spark, df, sf))
    assert four == expected(left) and any("[SECRET]" in t for _, t, _ in four)
    tok, pieces = Tokenizer.from_file(tokenizer_files()[0]), {}
    for x in P.run(spark, sf).collect():
        pieces.setdefault(x.doc_id, []).append((x.start, bytes(x.ids)))
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in left}
    assert set(pieces) == set(want)
    assert all(b"".join(b for _, b in sorted(pieces[i])) == struct.pack(f"<{len(ids)}I", *ids) for i, ids in want.items())
