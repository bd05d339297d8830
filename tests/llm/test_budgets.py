"""What the n-gram join leaves on disk."""

import os

import numpy as np

from vicinity.llm import ngram_join
from vicinity.llm.common import scratch_dir


def _bytes_in(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder.removeprefix("file:")) for name in names)


def test_leaves_of_the_first_pass_are_not_written_to_the_shared_folder(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 250)) for _ in range(1500)]
    texts += [t.replace(" w", " v", 1) for t in texts[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = _bytes_in(scratch_dir(spark))
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, size=5, percent=80).collect()}
    assert out == {k: k if k < 1500 else k - 1500 for k in range(1550)}
    assert _bytes_in(scratch_dir(spark)) - before < 0.6 * sum(map(len, texts))
