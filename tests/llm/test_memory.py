"""What a batch on its way to and from Python may hold, and what a worker keeps."""

import numpy as np
import pyarrow as pa

from tidewatch.llm import suffix_tree
from tidewatch.llm.common import BATCH_BYTES, give_back, ready


def test_a_batch_for_python_is_bounded_in_bytes(spark):
    ready(spark)
    docs = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "repeat('x', 200000) as text")

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes]), pa.array([part.num_rows])], ["size", "n"])

    got = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in got) == 200
    assert max(r["size"] for r in got) <= BATCH_BYTES + 400_000  # the row that fills it is whole


def test_pair_counts_with_many_depths(spark):
    """Rows leave the task depth by depth; their counts are those of a plain count."""
    ready(spark)
    lines = ["a b c d a b c d", "a b c d a b", "c d a b c d"] * 3
    texts = spark.createDataFrame([(t,) for t in lines], "text string").coalesce(1)
    every = np.full(2**(suffix_tree.MARK_BITS - 6), -1, np.int64)
    got = {(r["depth"], r["n"]) for r in suffix_tree.pair_counts(texts, 1, 3, every, every, every, every, 3, 1).groupBy("depth").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    sizes = [len(t.split()) + 1 for t in lines]
    assert got == {(d, sum(max(0, n - d) for n in sizes)) for d in (1, 2, 3)}


def test_freed_memory_goes_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [bytes(100_000) for _ in range(2000)]  # 200 MB in pieces too small for maps of their own
    last = bytes(100_000)  # the heap's end stays in use
    before = resident()
    del held
    give_back()
    assert before - resident() > 100_000_000 and len(last) == 100_000
