"""Wavelet shards of large vocabularies, and searches that read the files."""

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lexishift.llm import wavelet
from lexishift.llm.storage import workspace
from lexishift.llm.tokens import vocabulary_path


def test_ids_beyond_sixteen_bits(spark, tmp_path):
    words = {f"w{i}": i for i in range(70_000)}
    t = Tokenizer(models.WordLevel(words | {"[UNK]": 70_000}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "large.json")
    t.save(path)
    assert wavelet.bits_of(path) == 17 and wavelet.bits_of(vocabulary_path(wavelet.TOKENIZER)) == 16
    ids = np.array([69_999, 65_536, 3, 70_000])
    m = wavelet.WaveletMatrix.build(ids, 17)
    assert m.ids().tolist() == ids.tolist() and [m.access(i) for i in range(4)] == ids.tolist()
    with pytest.raises(ValueError, match="does not fit"):
        wavelet.WaveletMatrix.build(ids, 16)


def test_searches_read_the_files(spark):
    rng = np.random.default_rng(3)
    parts = ["the", " the", " a", "\n", "é", " word", " other words", "x"]
    rows = [(int(d) // 2, "".join(rng.choice(parts, rng.integers(0, 60)))) for d in range(120)] + [(None, None), (5, "")]
    folder, path = workspace(spark, "wavelet"), vocabulary_path(wavelet.TOKENIZER)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = wavelet.write_token_shards(docs, folder, path, shard_tokens=300)
    assert manifest.count() > 3
    from pyspark.sql import functions as F

    ids = []
    for r in manifest.orderBy("part", "seq").collect():
        with open(f"{folder.removeprefix('file://')}/{r['name']}", "rb") as f:
            ids += wavelet.read_shard(f.read())[0].ids().tolist()
    symbols = [0, ids[1], max(ids), 65_535, 1 << 20]
    got = {r.symbol: (r.n, r.first, r.last) for r in wavelet.search_token_shards(manifest, folder, symbols).groupBy("symbol").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()}
    places = {s: [i for i, x in enumerate(ids) if x == s] for s in symbols}
    assert got == {s: (len(p), p[0], p[-1]) for s, p in places.items() if p}
    asked = [0, 1, len(ids) // 2, len(ids) - 1, len(ids), -1]
    assert {r.place: r.token for r in wavelet.token_at(manifest, folder, asked).collect()} == {p: ids[p] for p in asked if 0 <= p < len(ids)}
