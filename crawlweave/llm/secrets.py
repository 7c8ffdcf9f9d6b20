"""Secret scans with an incremental blob ledger.

Every version of a path is content-addressed by sha256. Only pairs of blob and rule version that the ledger lacks are scanned, each
once however many paths hold it; findings, also empty ones, are appended to the ledger and joined back to all paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.runtime import dropped, measured, released, small, written

RULES = "1"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_RUN = bytes(1 if x in b"0123456789abcdef" else 0 for x in range(256))
SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every finding, in code points, ordered. Cheap whole-text tests come first."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    data = text.encode("utf-8", "surrogatepass")
    place = (lambda b: b) if len(data) == len(text) else (lambda b: len(data[:b].decode("utf-8", "surrogatepass")))
    if b"AKIA" in data:
        out += [(place(m.start()), 1, place(m.end())) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\x01" * LEAST_HEX in data.translate(_RUN):
        out += [(place(m.start()), 2, place(m.end())) for m in HEX.finditer(data)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"start": a, "rank": k, "end": b} for a, k, b in spans(x.as_py() or "")] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["blob", "spans"])


def scan(versions: DataFrame, ledger: str, rules: str = RULES) -> DataFrame:
    """path, version, blob, spans of every row of versions(path, version, text); null texts are empty. Findings go to the ledger.

    The ledger is a folder of Parquet in a store that all executors reach: blob, rules, spans. Rows that repeat, null paths and
    null versions stay rows; an empty table gives none and leaves the ledger as it is. Other columns are not read. Texts are scanned
    where they are read: the rows that have an unseen blob first, or, if those are fewer, the rows to pass over, are broadcast when
    they are few enough bytes; else texts are shuffled once."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select("path", "version", text.alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    named = written(rows.select("path", "version", digest.alias("blob")), "blob-names")
    target = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    shape = f"blob string, rules string, spans {SPANS}"
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    known = spark.read.schema(shape).parquet(ledger) if there else spark.createDataFrame([], shape)
    known = known.where(F.col("rules") == rules).withColumn("blob", F.unhex("blob"))
    one = named.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    unseen = written(one.join(known.select("blob"), "blob", "left_anti").select("blob", "at.path", "at.version"), "unseen-blobs")
    same = lambda a, b: a.path.eqNullSafe(b.path) & a.version.eqNullSafe(b.version) & (a.blob == b.blob)
    if unseen.head(1):
        passed = written(named.join(unseen, same(named, unseen), "left_anti").distinct(), "seen-blobs")
        todo = rows.withColumn("blob", digest)
        if measured(passed)[1] < measured(unseen)[1]:
            todo = todo.join(small(passed), same(todo, passed), "left_anti")
        else:
            todo = todo.join(small(unseen), same(todo, unseen), "left_semi")
        found = todo.select(F.lower(F.hex("blob")).alias("blob"), "text").mapInArrow(released(_scan), f"blob string, spans {SPANS}")
        found.select("blob", F.lit(rules).alias("rules"), "spans").write.mode("append").parquet(ledger)
        dropped(passed)
        known = spark.read.schema(shape).parquet(ledger).where(F.col("rules") == rules).withColumn("blob", F.unhex("blob"))
    hits = written(known.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "blob-findings")
    dropped(unseen)
    return named.join(small(hits), "blob", "left").select("path", "version", F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(column):
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs(text, ...) with the spans of found(blob, spans) in every text of that digest replaced by the mask, overlapping spans by one.

    All own columns stay, whatever their names; n_chars follows the text where there is one. Null and empty texts, repeated rows and
    rows of found without spans change nothing; an empty table gives no rows."""
    hit = written(found.where(F.size("spans") > 0).select(F.unhex("blob").alias("blob"), "spans").dropDuplicates(["blob"]), "findings")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    text = F.col("row.text")
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    before = lambda s, x: F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(F.struct(F.concat(s["out"], before(s, x), F.lit(mask)).alias("out"), x["end"].alias("at")))
    free = F.aggregate("spans", none, step)
    out = rows.join(small(hit), "blob", "left").withColumn("free", free)
    new = F.when(F.col("spans").isNull(), text).otherwise(F.concat("free.out", F.substring(text, F.col("free.at").cast("int") + 1, F.length(text))))
    size = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in docs.columns else None
    out = out.withColumn("new", new)
    return out.select(*[F.col("new").alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
