"""Counts summed a few blocks at a time give what one sum gives."""

import numpy as np

from lexishift.llm import brown


def test_sums_in_steps_change_nothing(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(words[i] for i in rng.zipf(1.3, rng.integers(1, 60)) % 60) + (" only%d" % d if d % 5 == 0 else "")) for d in range(240)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    score = lambda **more: sorted(map(tuple, brown.score_documents(docs, block_bytes=1500, core_words=20, classes=8, **more).collect()))
    whole, steps = score(), score(together=3)
    assert len(whole) == 242
    for a, b in zip(whole, steps, strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])
