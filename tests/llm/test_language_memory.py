"""Language identification holds n-grams of a bounded stretch of text, however large a batch is."""

import tracemalloc

import numpy as np
import pyarrow as pa

from webmetrics.llm import language_id


def test_memory_does_not_follow_the_batch():
    words = np.random.default_rng(3).integers(ord("a"), ord("z") + 1, (2000, 2000), dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode() for row in words])], ["text"])
    model = language_id.Model(["de", "en"], np.ones((language_id.BUCKETS, 2), np.float32))
    scored = language_id._scorer(model, "text")
    tracemalloc.start()
    try:
        (out,) = scored([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == 2000
    assert peak < 48e6
