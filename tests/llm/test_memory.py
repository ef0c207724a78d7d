"""Workers hold one block of texts beside an Arrow batch, whatever the batch's length."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from monthpick.llm import jaccard_join, toxicity


class Taken:
    """Stands for documents; mapInArrow gives the function that tasks would run."""

    columns = ["doc_id", "text"]

    def __init__(self, spark, schema=None):
        self.sparkSession, self.schema = spark, schema

    def select(self, *_):
        return Taken(self.sparkSession, self.sparkSession.createDataFrame([], "doc_id bigint").schema)

    where = select

    def mapInArrow(self, run, _):
        return run


def model():
    return toxicity.train([b"bad day", b"good day"] * 20, [1, 0] * 20)


PASSES = {
    "postings": (lambda docs: jaccard_join._postings(docs, (np.zeros(0, np.uint64), np.zeros(0, np.uint8)), 64), 42),
    "toxicity": (lambda docs: toxicity.score_toxicity(docs, model()), 30),
}


@pytest.mark.parametrize("name", PASSES)
def test_one_block_of_texts_is_held(spark, name):
    rng = np.random.default_rng(3)
    words = np.array([f"word{k}" for k in range(3_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 250)]) for _ in range(6_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    work, limit = PASSES[name]
    run = work(Taken(spark))
    del texts
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows and peak < limit
