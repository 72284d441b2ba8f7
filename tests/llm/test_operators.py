"""The ten operators on small frames with nulls, ties, empty texts and clashing columns, against brute force."""

import hashlib
import io
import re
import wave
import zlib
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
import pytest

from lexishift.llm import automaton, brown, chroma, linededup, minhash, packing, pii, quality, warc, wavelet
from lexishift.llm.storage import workspace
from lexishift.llm.tokens import vocabulary_path

LONG = "this line is long enough to be counted as a repeated passage"
TEXTS = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "a@b.co and 4111 1111 1111 1111, call +1 (743) 555-3824 or 10.0.0.1"), (None, "no id here"), (6, f"head\n{LONG}\ntail 漢字 😀"), (7, "the end <|endoftext|> of it  \n\n x")]
TEXTS += [(100 + i, f"{i}\n  {LONG.upper()} \nrest {i}") for i in range(6)] + [(2, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, _row string, n_chars long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_counts(docs, empty):
    rows = {(r.doc_id, r.text): r._verdict for r in quality.verdicts(docs).collect()}
    assert rows[0, None].metrics.n_words == 0 and rows[0, None].base_failed
    assert rows[6, TEXTS[6][1]].metrics.n_words == 16
    assert quality.quality_filter(docs).columns == docs.columns and quality.quality_filter(empty).count() == 0
    text = " ".join(f"the word{i}" for i in range(40)) + "\na b c a b c a b c"
    v = quality.verdicts(docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")).first()._verdict
    assert v.metrics.n_repeat_words == 9 and v.kept


def test_lines(docs, empty):
    rows = linededup.line_dedup(docs).collect()
    want = {100 + i: 1 for i in range(5)} | {6: 1, 105: 0}
    assert all(len(r._dropped) == want.get(r.doc_id, 0) for r in rows) and len(rows) == len(TEXTS)
    out = {r.doc_id: r for r in linededup.without_repeated_lines(docs).collect()}
    assert out[100].text == "0\nrest 0" and out[100].n_chars == 8 and out[0].text is None
    assert linededup.line_dedup(empty).count() == 0


def test_personal_data(docs, empty):
    rows = {(r.doc_id, r.text): [(s.kind, s.start, s.end) for s in r._spans] for r in pii.find_spans(docs).collect()}
    t = TEXTS[4][1]
    assert [(k, t[a:b]) for k, a, b in rows[4, t]] == [("email", "a@b.co"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824"), ("ip", "10.0.0.1")]
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[4] == "[EMAIL] and [CARD], call [PHONE] or [IP]"
    assert pii.redact(empty).count() == 0
    one = docs.sparkSession.createDataFrame([("IBAN DE89 3704 0044 0532 0130 00", ), ("DE88 3704 0044 0532 0130 00",), ("x 1.2.3.256 y 4111 1111 1111 1112",)], "text string")
    assert [len(r._spans) for r in pii.find_spans(one).collect()] == [1, 0, 0]


def test_ibans_end_at_their_length_and_context_reaches_over_matches(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN {iban} Please pay", f"IBAN {iban.replace(' ', '')} Please", f"IBAN {iban} BIC COBA", f"REF AB12 CODE XY {iban} 7 days", f"{iban} {iban}", "SSN 123-45-6789, 123-45-6780", "123-45-6789, 123-45-6780", "SSN 123-45-6789 " + "x" * 40 + " 123-45-6780"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[iban], [iban.replace(" ", "")], [iban], [iban], [iban, iban], ["123-45-6789", "123-45-6780"], [], ["123-45-6789"]]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r._spans] for r in pii.find_spans(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want
    out = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert out[2] == "IBAN [IBAN] BIC COBA" and out[5] == "SSN [SSN], [SSN]" and out[6] == texts[6]


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if w else frozenset()


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(4):
        base = rng.integers(0, 900, 120)
        for c in range(8):
            w = base.copy()
            w[rng.integers(0, 120, c % 3)] = 1000 + c
            rows.append((len(rows), " ".join(f"w{x}" for x in w)))
    rows += [(1000 + i, t) for i, t in TEXTS if i is not None]
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)) for r in got) and len(got) == len(rows)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == sorted((i if i is not None else -1) for i, _ in TEXTS if i != 3)
    assert minhash.near_duplicates(empty).count() == 0


def test_pipeline_drops_copies_between_general_and_contract_similarity(spark):
    import corpus_pipeline

    assert minhash.plan_for(0.85) == minhash.Plan(17, 20, 16, 36)
    plan = minhash.plan_for(0.8)
    assert (1 - 0.8**minhash.ROWS) ** plan.bands < minhash.BAND_MISS
    rng, rows = np.random.default_rng(8), []
    for g in range(30):
        w = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 104)]
        v = list(w)
        v[20], v[60] = "x", "y"  # 10 of 100 shingles: similarity 90 / 110
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [2 * g for g in range(30)]
    assert minhash.keep_one(docs, similarity=0.85).count() == 60


def library_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return t, [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_automaton_and_wavelet(spark, docs, empty):
    texts = [t for _, t in TEXTS]
    lib, ids = library_ids("byte_bpe_50k.json", texts)
    want = sorted((len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for x in ids)
    path = vocabulary_path("byte_bpe_50k.json")
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in automaton.encode_documents(docs, path).collect()) == want
    folder = workspace(spark, "test")
    rows = wavelet.read_token_shards(wavelet.write_token_shards(docs.select("doc_id", "text"), folder, path, shard_tokens=40), folder).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for x in ids)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and [r.doc_id for r in rows if r.doc_id is not None] == sorted(i for i, _ in TEXTS if i is not None)
    folder = workspace(spark, "test")
    assert wavelet.read_token_shards(wavelet.write_token_shards(empty.select("doc_id", "text"), folder, path), folder).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50, 3000)
    m, _, _ = wavelet.read_shard(wavelet.write_shard(ids, [1], np.array([3000]), 16))
    assert (m.ids() == ids).all() and [m.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    places = np.flatnonzero(ids == 7)
    assert m.count(7) == len(places) and [m.select(7, k) for k in range(len(places))] == places.tolist() and m.select(7, len(places)) == -1
    with pytest.raises(ValueError):
        wavelet.read_shard(wavelet.write_shard(ids, [1], np.array([3000]), 16)[:-1])


def test_packing(docs, empty):
    _, ids = library_ids("word_bpe_49k.json", [t for _, t in TEXTS])
    rows = packing.pack_documents(docs, capacity=32).collect()
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 32 and len(used) <= ceil(sum(used.values()) / 32) + 1
    assert packing.pack_documents(empty).count() == 0


def test_configuration_program_covers_exactly():
    h = np.zeros(65, np.int64)
    h[[3, 7, 11, 20, 33, 64]] = [900, 700, 500, 400, 300, 20]
    plan = packing.solve(h, 64)
    covered = sum(n * np.bincount(list(c), list(c.values()), 65) for n, c in plan)
    assert (covered == h).all() and all(sum(k * v for k, v in c.items()) <= 64 for _, c in plan) and sum(n for n, _ in plan) <= 1.02 * (h @ np.arange(65)) / 64 + 1


def test_warc(spark):
    rows = [(5, "u5", "<p>x</p>"), (3, "u3", "<p>x</p>"), (9, None, None), (4, "u4", ""), (3, "u3", "<p>x</p>"), (None, "u", "<p>x</p>"), (8, "a\r\nb", "é😀" * 50)]
    folder = workspace(spark, "test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages, folder, roll_bytes=500), folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(5, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 4), (4, "response", None), (None, "response", None), (8, "response", None)])
    assert {(r.page_id, r.payload_bytes) for r in got} == {(i, len((h or "").encode())) for i, _, h in rows}
    folder = workspace(spark, "test")
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).count() == 0


def test_brown(docs, empty):
    rows = brown.score_documents(docs.select("doc_id", "text"), classes=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in TEXTS if not held(i) for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in TEXTS:
        words = [*(t or "").encode().lower().split(), None]
        want.append((i or -1, held(i), len(words), sum(w in count for w in words), n, round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words), 6)))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == sorted(want)
    assert all(r.score < 0 for r in rows) and brown.score_documents(empty.select("doc_id", "text")).count() == 0


def test_exchange_finds_planted_classes():
    pairs = np.zeros((8, 8))
    pairs[:4, 4:], pairs[4:, :4] = 10, 10
    pairs += np.random.default_rng(0).integers(1, 4, (8, 8))
    label = brown.exchange(pairs, 2)
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[4]


def test_brown_gains_equal_recounted_likelihood():
    rng = np.random.default_rng(5)
    for n in (60, 2000):  # counts within and beyond the table of small ones
        seq, label, first = rng.integers(0, 9, n), rng.integers(0, 3, 9).astype(np.uint8), np.arange(n) % 12 == 0
        train = np.repeat(rng.random(-(-n // 12)) < 0.8, 12)[:n]
        sizes, keys, counts = brown.neighbour_counts(label, seq, train, first, 3)
        dense = np.zeros((9, 7))
        dense[np.repeat(np.arange(9), sizes), keys] = counts
        big = lambda x: brown.class_pairs(x, seq, train, first, 3).reshape(3, 3).astype(float)
        got = brown.Gains(big(label))(dense, label.astype(int))
        for w in range(9):
            want = [brown.likelihood(big(np.where(np.arange(9) == w, c, label).astype(np.uint8))) for c in range(3)]
            assert np.allclose(got[w] - got[w][0], np.array(want) - want[0])


def test_brown_probabilities_sum_to_one():
    rng = np.random.default_rng(7)
    count, kind = rng.integers(1, 50, 40), rng.integers(0, 5, 40)
    step = brown.step_logs(rng.integers(0, 30, (5, 5)).astype(float), 0.07)
    emit = count / np.bincount(kind, count, 5)[kind]
    for before in range(6):  # five classes and the unknown type
        assert abs((10 ** step[before, kind] * emit).sum() + 10 ** step[before, 5] - 1) < 1e-9


def test_brown_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(9)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    texts = [" ".join(kinds[j % 3][rng.integers(0, 30)] for j in range(60)) for _ in range(300)]
    rows = brown.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classes=6, core_words=20).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_brown_moves_words_beyond_the_core_alike_in_any_blocks(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[k % 2]}{rng.integers(0, 40)}" for k in range(30)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in brown.score_documents(rows, size, core_words=6, classes=4).collect()} for size in (1 << 20, 2000)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in scores[0])
    assert np.mean(list(scores[0].values())) / 31 > -1.75  # alternating kinds are found: log10(1/40) is -1.60, one class would give -1.90


def test_chroma(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 64))
    near = base[0] + rng.normal(size=64) * 0.02
    shifted = np.concatenate([rng.normal(size=8), base[1][:56]])
    rows = [(100 * i, v.tolist()) for i, v in enumerate(base)] + [(7, near.tolist()), (8, shifted.tolist()), (9, base[2].tolist()), (10, None), (None, base[3].tolist()), (11, []), (12, [0.0] * 64), (500, base[5].tolist())]
    schema = "vec_id long, embedding array<double>"
    got = chroma.align(chroma.recordings(spark.createDataFrame(rows, schema)))[1].collect()
    pairs = Counter((r.query_id, r.match_id) for r in got)
    near_one = {(0, 7)} if chroma.fingerprint(*chroma.sound(chroma.play(near))).tolist() != chroma.fingerprint(*chroma.sound(chroma.play(base[0]))).tolist() else set()
    assert set(pairs) == {(100 * i, 100 * i) for i in (0, 1, 3, 4, 5)} | {(200, 9), (100, 8)} | near_one and pairs[500, 500] == 2
    assert {r.shift for r in got if (r.query_id, r.match_id) == (100, 8)} == {16} and len(chroma.fingerprint(*chroma.sound(b"junk"))) == 0
    assert [x.count() for x in chroma.align(chroma.recordings(spark.createDataFrame([], schema)))] == [0, 0]


def with_noise(recording, rng, deviation, shift):
    """The recording with noise on its 8-bit samples, cut by ``shift`` samples."""
    with wave.open(io.BytesIO(recording)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), np.uint8)[shift:]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(chroma.RATE)
        w.writeframes(np.clip(x + rng.normal(0, deviation, len(x)), 0, 255).astype(np.uint8).tobytes())
    return out.getvalue()


def least_error(x, y):
    """The least share of differing bits over all offsets with enough overlap: the definition of a match, by brute force."""
    best, n = 1.0, chroma.MIN_OVERLAP
    for s in range(n - len(x), len(y) - n + 1):
        low, high = max(0, -s), min(len(x), len(y) - s)
        best = min(best, np.bitwise_count(x[low:high] ^ y[low + s : high + s]).mean() / 32)
    return best


def test_chroma_recall_against_all_offsets(spark):
    """In every setting of noise and cut, nine of ten recordings that match at some offset are found; nothing else is."""
    rng = np.random.default_rng(11)
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(40).collect()
    audio = {100 * i: chroma.play(r.embedding) for i, r in enumerate(vectors)}
    settings = [(d, s) for d in (30, 60, 100) for s in (0, 50, 64, 4000)]
    for i in range(30):
        for k, (deviation, shift) in enumerate(settings):
            audio[100 * i + k + 1] = with_noise(audio[100 * i], rng, deviation, shift)
    prints = {i: chroma.fingerprint(*chroma.sound(a)) for i, a in audio.items()}
    want = {(q, i) for q in prints if q % 100 == 0 for i in prints if i != q and least_error(prints[q], prints[i]) <= chroma.MAX_ERROR}
    rows = chroma.align(spark.createDataFrame(list(audio.items()), "rec_id long, audio binary"))[1].collect()
    got = {(r.query_id, r.match_id) for r in rows if r.query_id != r.match_id}
    assert len(want) > 320 and got <= want
    for k in range(len(settings)):
        asked = {(q, i) for q, i in want if i == q + k + 1}
        assert len(asked) >= 24 and len(got & asked) >= 0.9 * len(asked), settings[k]


def test_chroma_query_tells_class_and_best_query_of_each_recording(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 64))
    rows = [(100, base[0].tolist()), (200, base[0].tolist()), (5, base[0].tolist()), (300, base[1].tolist()), (7, np.concatenate([rng.normal(size=8), base[1][:56]]).tolist()), (8, base[2].tolist()), (9, None), (5, base[0].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter((r.rec_id, r.class_id, r.n_queries, r.query_id, r.shift) for r in chroma.op9_chroma(spark, str(tmp_path)).collect())
    copies = [(i, 5, 2, 100, 0) for i in (100, 200, 5, 5)]
    assert got == Counter([*copies, (300, 300, 1, 300, 0), (7, 7, 1, 300, 16), (8, 8, 0, None, None), (9, None, 0, None, None)])


def test_chroma_keys_are_not_broadcast_by_the_size_of_a_file(spark, monkeypatch):
    """A compressed file doesn't tell how many keys are made of it; with 615,384 recordings the driver could not hold them."""
    plans, write = {}, chroma.materialise

    def told(df, path, *more):
        plans[path.rpartition("/")[2]] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, path, *more)

    monkeypatch.setattr(chroma, "materialise", told)
    vectors = np.random.default_rng(8).normal(size=(6, 64))
    rows = [(100 * i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[0].tolist()), (9, [*vectors[2][:8].tolist(), *vectors[1][:56].tolist()])]
    matches = chroma.align(chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))[1]
    assert "SortMergeJoin" in plans["votes"] and "BroadcastHashJoin" not in plans["votes"]
    assert {(r.query_id, r.match_id, r.shift) for r in matches.filter("match_id <> class_id").collect()} == {(100, 9, 16)}


@pytest.mark.parametrize(("held", "cells"), [((1 << 20, 1 << 22), 64), ((300, 500), 3), ((1 << 20, 1 << 22), 1)])
def test_chroma_votes_are_compared_in_cells(spark, monkeypatch, held, cells):
    """Fingerprints of any lengths and offsets of both signs, whatever cells they are dealt into, against each vote alone."""
    monkeypatch.setattr(chroma, "HELD", held)
    monkeypatch.setattr(chroma, "CELLS", cells)
    rng = np.random.default_rng(21)
    prints = {int(i): rng.integers(0, 1 << 32, int(rng.integers(64, 150)), np.uint64).astype(np.uint32) for i in rng.choice(10**12, 40, False) - 5 * 10**11}
    ids = list(prints)
    for i in range(0, 30, 3):
        prints[ids[i + 1]] = np.concatenate([prints[ids[i + 1]][: 7 * i], prints[ids[i]]])  # a later beginning
    votes = {(ids[i], ids[j], int(s)) for i in range(10) for j in range(40) if i != j for s in rng.integers(-120, 120, 3)} | {(ids[i], ids[i + 1], min(7 * i, len(prints[ids[i + 1]]) - len(prints[ids[i]]))) for i in range(0, 10, 3)}
    table = lambda some: spark.createDataFrame([(i, prints[i].view(np.int32).tolist()) for i in some], "rep long, print array<int>")
    want = {}
    for a, b, s in votes:
        low, high = max(0, -s), min(len(prints[a]), len(prints[b]) - s)
        if high - low >= 64 and (error := np.bitwise_count(prints[a][low:high] ^ prints[b][low + s : high + s]).sum() / (32.0 * (high - low))) <= 0.5:
            want[a, b, s, 1] = error
    got = chroma.compared(spark.createDataFrame([(*v, 1) for v in sorted(votes)], "a long, b long, shift int, votes long"), table(ids[:10]), table(ids), 0.5, 64).collect()
    assert len(want) > 100 and 0.0 in want.values() and len(got) == len(want) and {(r.a, r.b, r.shift, r.votes): r.bit_error for r in got} == want
    monkeypatch.setattr(chroma, "TOGETHER", 100)
    part = pa.RecordBatch.from_pylist([{"a": a, "b": b, "shift": s, "votes": 1} for a, b, s in sorted(votes)], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shift", pa.int32()), ("votes", pa.int64())]))
    held = lambda *some: chroma._Prints([(np.array(x), pa.array([prints[i].view(np.int32) for i in x], pa.list_(pa.int32()))) for x in some])
    assert sum(x.num_rows for x in chroma._matching(part, held(ids[:10]), held(ids[:25], ids[25:]), 0.5, 64)) == len(want)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    text = " ".join(f"the word{i}" for i in range(60))
    rows = docs.unionByName(spark.createDataFrame([(900, text + " a@b.co", "x", 1), (901, text + " a@b.co", "x", 1)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns
    assert [(r.doc_id, r.text) for r in rows.collect()] == [(900, text + " [EMAIL]")]
    assert not re.search("a@b", rows.first().text) and corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == 1
