"""Other columns that bear an operator's own names change none of its rows; very long texts and recordings are taken whole."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexishift.llm import automaton, brown, chroma, minhash, packing, warc, wavelet
from lexishift.llm.storage import workspace
from lexishift.llm.tokens import vocabulary_path

OWN = ["part", "seq", "row", "rep", "key", "_row", "_id", "n", "g", "p", "block", "piece", "start", "length", "n_tokens", "record_type", "refers_to", "payload_digest", "digest", "size", "kind", "fine", "class_id", "print", "print_a", "audio_", "members", "shift", "votes"]


def beside(df):
    """``df`` with columns of the operators' own names before and after its own."""
    return df.select(*[F.lit("mine").alias(c) for c in OWN[::2]], *df.columns, *[F.lit(None).cast("int").alias(c) for c in OWN[1::2]])


def rows_of(df):
    return Counter(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two"), (1, "one two"), (None, None), (None, "x y"), (2, "the end " * 30), (3, ""), (4, "漢字 😀 é\n\n x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_clashing_columns_of_token_operators(docs):
    byte_bpe, word_bpe = vocabulary_path(automaton.TOKENIZER), vocabulary_path(packing.TOKENIZER)
    assert rows_of(automaton.encode_documents(beside(docs), byte_bpe)) == rows_of(automaton.encode_documents(docs, byte_bpe))
    place = ("sequence_id", "offset", "row")
    packed = [packing.pack_documents(d, word_bpe, capacity=32).drop(*place) for d in (beside(docs), docs)]
    assert rows_of(packed[0]) == rows_of(packed[1])
    shards = []
    for d in (beside(docs), docs):
        folder = workspace(docs.sparkSession, "wavelet")
        shards.append(rows_of(wavelet.read_token_shards(wavelet.write_token_shards(d, folder, byte_bpe, shard_tokens=20), folder)))
    assert shards[0] == shards[1] and sum(shards[0].values()) == docs.count()


def test_clashing_columns_of_archives(spark):
    rows = [(5, "u5", "<p>x</p>"), (3, "u3", "<p>x</p>"), (9, None, None), (4, "u4", ""), (3, "u3", "<p>x</p>"), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = []
    for d in (beside(pages), pages):
        folder = workspace(spark, "warc")
        read.append(rows_of(warc.read_warc(warc.write_warc(d, folder, roll_bytes=400), folder)))
    assert read[0] == read[1] and sum(read[0].values()) == len(rows)


def test_clashing_columns_and_a_very_long_recording(spark):
    """Two recordings of minutes, the second without the first's beginning, align at the frames that are missing."""
    rng = np.random.default_rng(8)
    tune = rng.normal(size=3_000)
    rows = [(100, chroma.play(tune)), (7, chroma.play(tune[500:])), (8, chroma.play(rng.normal(size=64))), (9, None), (None, chroma.play(tune))]
    media = spark.createDataFrame(rows, "rec_id long, audio binary")
    told = [[rows_of(x) for x in chroma.align(d)] for d in (beside(media), media)]
    assert told[0] == told[1]
    members, matches = chroma.align(media)
    assert {(r.rec_id, r.class_id) for r in members.collect()} == {(100, 100), (7, 7), (8, 8), (9, None)}
    found = {r.match_id: r["shift"] for r in matches.collect()}
    assert set(found) == {100, 7} and found[100] == 0 and abs(found[7]) == 500 * chroma.NOTE // chroma.HOP


def test_very_long_near_copies_are_compared_whole(spark):
    """The texts agree in their first 20,000 words; the one that departs after them is no copy, the one with few changed words is."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 60_000)]
    few, other = words.copy(), words[:20_000] + [f"v{x}" for x in rng.integers(0, 50_000, 40_000)]
    for at in rng.integers(0, len(few), 300):
        few[at] = "changed"
    texts = {4: words, 2: few, 3: other}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    assert 100 * len(sets[4] & sets[2]) >= 85 * len(sets[4] | sets[2]) and 100 * len(sets[4] & sets[3]) < 85 * len(sets[4] | sets[3])
    docs = beside(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {4: (len(sets[4]), 2), 2: (len(sets[2]), 2), 3: (len(sets[3]), 3)}


def test_very_long_texts_are_scored_whole(spark):
    """Counts and base score of texts longer than a block, against plain Python; each has its own score."""
    rng = np.random.default_rng(6)
    texts = {i: " ".join(f"w{min(x, 3_000)}" for x in rng.zipf(1.3, n)) for i, n in enumerate((30_000, 50, 0, 20_000, 700, 40, 9_000, 60, 25_000))}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in texts.items():
        words = [*t.split(), None]
        want[i] = (held[i], len(words), sum(w in count for w in words), n, round(sum(float(np.log10((count[w] + 1) / (n + v + 1))) for w in words), 5))
    docs = beside(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for size in (1 << 24, 4_000):
        got = brown.score_documents(docs, block_bytes=size, classes=8).collect()
        assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got} == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_a_group_that_no_pivot_has_joined_is_not_paired_with_itself(spark, monkeypatch):
    """300 variants of one text, linked with each other, reach the early shingles as 300 components: they become one by some of their 44,850 links."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    made, write = [], minhash.materialise

    def counted(df, path):
        out = write(df, path)
        if path.rsplit("/", 1)[-1].startswith("pairs-"):
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(words[: (at := 5 + i % 190)] + [f"own{i}"] + words[at + 1 :])) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert len(got) == 300 and {r.component_id for r in got} == {0}
    assert sum(made) < 300 * 20
