"""Workers outlive tasks: what one keeps counts against its executor in every later stage."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlweave import runtime
from crawlweave.llm import packing
from crawlweave.llm.registry import tokenizer_files


def test_packing_leaves_no_words_in_workers(spark):
    def words_kept(batches):
        for _ in batches:
            pass
        time.sleep(0.5)  # so that all workers that wait get a task
        yield pa.RecordBatch.from_pydict({"words": pa.array([sum(map(len, packing._bpe.values()))], pa.int64())})

    text = F.concat_ws(" ", *[F.format_string("w%dx%d", "id", F.lit(i)) for i in range(40)])
    docs = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert packing.pack(docs, *tokenizer_files()).agg(F.countDistinct("doc_id")).first()[0] == 2000
    kept = spark.range(0, 16, 1, 16).mapInArrow(words_kept, "words long").collect()
    assert len(kept) == 16 and {r.words for r in kept} == {0}


def test_tasks_give_memory_back_however_they_end(monkeypatch):
    given = []
    monkeypatch.setattr(runtime, "give_back", lambda: given.append(1))
    assert list(runtime.released(lambda batches: (2 * x for x in batches))(iter([1, 2, 3]))) == [2, 4, 6] and given == [1]
    with pytest.raises(ZeroDivisionError):
        list(runtime.released(lambda batches: (1 // x for x in batches))(iter([1, 0])))
    assert given == [1, 1]
    begun = runtime.released(lambda batches: batches)(x for x in range(3))
    assert next(begun) == 0
    begun.close()
    assert given == [1, 1, 1]


def test_freed_arrow_memory_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) / 1024

    runtime.give_back()
    before = held()
    parts = [bytes([i % 251]) * 1500 for i in range(100_000)]
    last = parts[-1]
    del parts
    runtime.give_back()
    assert len(last) == 1500 and held() - before < 30
