"""What Python workers hold between tasks: an executor keeps them all, so what one task leaves counts in all later stages."""

import re
from pathlib import Path

import pandas as pd
import public_tokenizers as P
import pyarrow as pa

from tidemill.llm import bpe, lsh_forest
from tidemill.llm.common import BATCH_BYTES, bounded_batches, read_table, released


def held_mb():
    return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_goes_back():
    def work(batches):
        for n in batches:
            made = [bytes(2000) for _ in range(50_000)]
            pinned.append(made[-1])  # nothing below it goes back by itself
            del made
            yield n

    pinned, cleared = [], []
    list(work([1]))
    before = held_mb()
    assert list(released(work, lambda: cleared.append(1))([1, 2])) == [1, 2]
    assert held_mb() < before - 50 and cleared == [1]
    next(one := released(work, lambda: cleared.append(2))([1, 2]))
    one.close()  # a reader that stops early
    assert cleared == [1, 2]


def test_near_duplicates_leaves_no_words(spark, sf_dir):
    def words(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(lsh_forest._words)] * len(batch)})

    found = lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"))
    assert found.where("not kept").count()
    assert spark.range(0, 64, 1, 16).mapInPandas(words, "n long").agg({"n": "max"}).first()[0] == 0


def test_no_task_of_bpe_chains_more_than_two_workers(spark, documents):
    docs = spark.createDataFrame(documents[["doc_id", "text"]].head(5))
    plan = bpe.digests(spark, docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    above = re.split(r"Join LeftOuter, \(slice", plan)[0]
    assert above != plan and above.count("MapInArrow") == 2


def test_gathered_batches_keep_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"head": [n], "ids": pa.array([[n] * k], pa.list_(pa.int32()))}) for n, k in enumerate((3, 2, 9, 0, 1, 4))]
    got = list(bpe._gathered(iter(batches), 5))
    assert [b.column("head").to_pylist() for b in got] == [[0, 1], [2], [3, 4, 5]]
    assert [x for b in got for x in b.column("ids").to_pylist()] == [[0] * 3, [1] * 2, [2] * 9, [], [4], [5] * 4]


def test_batches_are_bounded_unless_the_session_says(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    bounded_batches(other)
    assert other.conf.get(name) == str(BATCH_BYTES)
    other.conf.set(name, "1000000")
    bounded_batches(other)
    assert other.conf.get(name) == "1000000"
