"""The queries of this subpackage, with production parameters, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.llm import chunks, decontam, jaccard, mainhtml, packing, secrets, slots, topk, toxicity, wordpieces
from crawlweave.runtime import new_path, ship, table


def tokenizer_files() -> tuple[str, str, str]:
    """Where the byte-level vocabulary lies, as a tokenizers file and as ranks, and its pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), *tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(documents(spark, sf_dir))


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(documents(spark, sf_dir), tokenizer_files()[1])


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = secrets.scan(versions, new_path(spark, "blob-ledger"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    text = secrets.span_text(F.col("spans"))
    return found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"), "blob")


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slots.sharded(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = mainhtml.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = F.aggregate(F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int")), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.get("spans", 2 * i + 1) - F.get("spans", 2 * i), F.lit(0)))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_harmonic_packing, op2_chunk_dedup, op3_kdtree_topk, op4_ngram_jaccard, op5_pu_toxicity, op6_token_counts, op7_secret_ledger, op8_virtual_slots, op9_main_text, op10_wu_manber, pipeline]
    return {f.__name__: f for f in own}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = d.doc_id
"""

OP10 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM bw WHERE len(ws) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bx),
dx AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, ns WHERE len(ws) >= n)),
m AS (SELECT dx.doc_id, dx.n, dx.i, bx.item_id FROM dx JOIN bx ON dx.n = bx.n AND dx.gram = bx.gram),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_kdtree_topk": OP3, "op4_ngram_jaccard": OP4, "op10_wu_manber": OP10}
