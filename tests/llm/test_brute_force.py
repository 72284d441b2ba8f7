"""Queries and the pipeline against plain Python, and what the small frames leave out: long texts, empty tables, clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexishift.llm import automaton, brown, linededup, minhash, packing, pii, quality, warc, wavelet
from lexishift.llm.storage import workspace
from lexishift.llm.tokens import vocabulary_path

# The base patterns of personal data.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def holds(kind, x):
    digits = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    rank = list(PATTERNS)
    found = [(m.start(), rank.index(k), f"{k}:{m.start()}:{m.end()}") for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return [x for _, _, x in sorted(found)]


def random_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    parts = [" ", " ", " ", "-", ".", "@", "+", "(", ")", "a", "Zé", "7", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "10.0.0.1", "1.2.3.4.5", "a.b@c.de", "x@y", "+1 (743) 555-3824", "+49 30 123456", "\n", "漢😀"]
    return ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(n)]


def saved(spark, tmp_path, rows, schema="doc_id long, text string", name="documents"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_personal_data_query(spark, tmp_path):
    texts = [*random_texts(1500), None, "", "1 " * 40_000 + "a@b.co", "x@" * 20_000 + "y.zz", "9" * 50_000, "+1" + " (" * 20_000 + "5"]
    rows = pii.op3_pii(spark, saved(spark, tmp_path, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        count = Counter(x.split(":")[0] for x in want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in PATTERNS)
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(0, None), (1, ""), (2, " \n\n  a   b\n"), (3, "a" * 5000), (4, LONG), (5, "x\0y  \t z<|endoftext|> \n\n<|endoftext|>"), (6, LONG), (6, "other"), (None, "no id"), (7, "é漢😀 " * 50)]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return t, lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_bpe_query_by_document(spark, tmp_path):
    t, ids = library("byte_bpe_50k.json")
    rows = automaton.op6_bpe(spark, saved(spark, tmp_path, ODD)).collect()
    want = Counter((i, len(ids(x)), hashlib.sha256(",".join(map(str, ids(x))).encode()).hexdigest(), hashlib.sha256(t.decode(ids(x), skip_special_tokens=False).encode()).hexdigest()) for i, x in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def merged(word, ranks):
    """Plain merging: the lowest rank, leftmost first."""
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return word
        pair = word[best[1]], word[best[1] + 1]
        out, i = [], 0
        while i < len(word):
            if tuple(word[i : i + 2]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out


def test_compiled_gadgets_accept_exactly_what_merging_makes():
    rng = np.random.default_rng(12)
    for _ in range(30):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            u, v = rng.choice(tokens, 2)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        number = {t: i for i, t in enumerate(tokens)}
        arcs, state, place, made, start = automaton.compile_merges(len(tokens), [(number[u], number[v], number[u + v]) for u, v in merges])
        assert len(arcs) <= len(tokens) + 1
        follows = lambda s, t: bool(arcs[s, place[t] >> 3] >> (place[t] & 7) & 1) and bool(made[t])
        ranks = {m: i for i, m in enumerate(merges)}

        def paths(text, s):
            if not text:
                yield []
            for t in tokens:
                if text.startswith(t) and follows(s, number[t]):
                    for rest in paths(text[len(t) :], state[number[t]]):
                        yield [t, *rest]

        for _ in range(40):
            text = "".join(rng.choice(["a", "b", "c"], rng.integers(1, 9)))
            assert list(paths(text, start)) == [merged(list(text), ranks)]


def test_wavelet_query_by_document(spark, tmp_path):
    _, ids = library("byte_bpe_50k.json")
    rows = sorted(wavelet.op4_wavelet(spark, saved(spark, tmp_path, ODD)).collect(), key=lambda r: r.start)
    want = Counter((i, len(ids(x)) + 1, zlib.crc32(np.array([*ids(x), 0], "<u4").tobytes())) for i, x in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def packed_pieces(rows, ids, capacity):
    out = Counter()
    for i, x in rows:
        line = [*ids(x), 0]
        for k in range(0, len(line), capacity):
            part = line[k : k + capacity]
            out[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_packing(rows, want, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= capacity
    return len(used)


def test_packing_query_by_piece(spark, tmp_path):
    _, ids = library("word_bpe_49k.json")
    check_packing(packing.op7_packing(spark, saved(spark, tmp_path, ODD)).collect(), packed_pieces(ODD, ids, 2048), 2048)


def test_small_packings_are_solved_by_the_program():
    rng = np.random.default_rng(5)
    for _ in range(20):  # triples that fill a sequence exactly: best-fit decreasing alone needs more
        lengths = np.zeros(101, np.int64)
        for _ in range(8):
            a = int(rng.integers(26, 34))
            b = int(rng.integers(26, 34))
            for x in (a, b, 100 - a - b):
                lengths[x] += 1
        fitted = packing.Cover(lengths)
        fitted.best_fit()
        n = sum(k for k, _ in packing.solve(lengths, 100))
        assert 8 <= n <= fitted.sequences() and n <= 9


def test_bounded_knapsack_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(30):
        most, weight = np.zeros(31, np.int64), np.zeros(31)
        some = rng.choice(np.arange(1, 31), 4, replace=False)
        most[some], weight[some] = rng.integers(1, 4, 4), rng.random(4)
        got = packing.bounded_knapsack(weight, 30, most)
        best = max(float(np.array(c) @ weight[some]) for c in np.ndindex(*(most[some] + 1)) if np.array(c) @ some <= 30)
        assert (got <= most).all() and got @ np.arange(31) <= 30 and abs(got @ weight - best) < 1e-9


PAGES = [(5, "u5", "<p>x</p>"), (3, "u3", "<p>x</p>"), (9, None, None), (4, "u4", ""), (3, "u3", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "v", "z" * 70_000), (8, "a\r\nb", "é😀" * 50), (-(2**63), "low", "low"), (2**63 - 1, "high", "<p>x</p>")]
PAGES += [(100 + i, f"p{i}", f"body {i % 7} " * (i % 50)) for i in range(400)] + [(77, f"same{i}", f"one id {i}" * 30) for i in range(200)]


def archives(folder):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".warc.gz")]
    return {f.base_name: store.open_input_stream(f.path, compression=None).read() for f in files}


def test_warc_is_deterministic_and_tells_digests(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_PARTS", 8)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    seen = []
    for df in (pages, pages.repartition(7, "url"), pages.repartition(2).orderBy(F.desc("url"))):
        folder = workspace(spark, "test")
        manifest = warc.write_warc(df, folder, roll_bytes=4000)
        seen.append(archives(folder))
    assert len(seen[0]) > 8 and seen[0] == seen[1] == seen[2]
    rows = warc.read_warc(manifest, folder).collect()
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = Counter()
    for i, u, h in PAGES:
        body = (h or "").encode()
        target = least[h or ""] if i is not None and least[h or ""] != i else None
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if target is None else "revisit", target] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    heads = [x.split(b"\r\n\r\n")[0] for data in seen[0].values() for x in warc.members(__import__("io").BytesIO(data))]
    ids = [re.search(rb"WARC-Record-ID: (\S+)", h)[1] for h in heads]
    assert len(set(ids)) == len(PAGES)


def shingle_set(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < width else frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if w else frozenset()


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    rng = np.random.default_rng(3)
    a, b = (" ".join(f"{k}{x}" for x in rng.integers(0, 900, 60)) for k in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b + " more"), (9, "alone " + a[:50]), (9, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (9, 9), (9, 1)])
    assert Counter(minhash.keep_one(docs).collect()) == Counter(spark.createDataFrame([rows[0], rows[1], rows[4]], docs.schema).collect())


CLASH = ("_id", "_th", "_lines", "_dropped", "_kept_text", "_spans", "_verdict", "_row", "_gone", "_text", "rep", "comp", "part", "row")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (2, LONG, "y"), (3, "the " * 60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASH])


def test_clashing_names_and_long_texts(clashing):
    assert linededup.line_dedup(clashing).count() == pii.find_spans(clashing).count() == quality.verdicts(clashing).count() == 5
    rows = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(rows.sparkSession, rows, "")
        assert rows.columns == clashing.columns
    assert {r.doc_id for r in rows.collect()} <= {1, 2, 3, None}
    assert brown.score_documents(clashing).count() == 5 and minhash.near_duplicates(clashing).count() == 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    saved(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if n < 50:
        return False
    windows = defaultdict(list)
    for i in range(n - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    symbols = sum(c in quality.SYMBOLS for c in text)
    return 100 * len(repeated) <= 50 * n and 1.5 <= sum(map(len, words)) / n <= 20 and symbols / n <= 0.25 and stop / n >= 0.005 and (len(lines) - len(set(lines))) / len(lines) <= 0.6 and letters / n >= 0.5


def plain_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            held[key(x)].add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == i)) for i, t in docs]


def plain_near(docs):
    sets, comp = {i: shingle_set(t) for i, t in docs}, {}

    def find(x):
        while comp.get(x, x) != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return [(i, t) for i, t in docs if find(i) == i]


def plain_redact(docs):
    out = []
    for i, t in docs:
        for kind, p in PATTERNS.items():
            t = re.sub(p, lambda m, k=kind: f"[{k.upper()}]" if holds(k, m.group()) else m.group(), t)
        out.append((i, t))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = np.random.default_rng(21)
    passage = "this passage of a good forty characters stands in many documents of the corpus"
    docs = []
    for g in range(40):
        words = [f"the w{x}" if x % 3 == 0 else f"w{x}" for x in rng.integers(0, 4000, 120)]
        for copy in range(rng.integers(1, 4)):
            own = list(words)
            for at in rng.integers(0, 120, copy * 2):
                own[at] = f"new{rng.integers(0, 9999)}"
            lines = [" ".join(own[:60]), " ".join(own[60:]), "mail a.b@c.de or 10.0.0.1" if g % 3 == 0 else "4111 1111 1111 1111"]
            if g % 2:
                lines.insert(1, passage)
            docs.append((len(docs), "\n".join(lines)))
    docs += [(len(docs), "too short"), (len(docs) + 1, "again and again " * 40), (len(docs) + 2, "# $ % & " * 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = saved(spark, tmp_path, [(i, t, "en", "x", len(t)) for i, t in docs], schema)
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = plain_redact(plain_near(plain_lines([(i, t) for i, t in docs if plain_quality(t)])))
    _, ids = library("word_bpe_49k.json")
    assert 20 < len(kept) < len(docs) - 10
    check_packing(rows, packed_pieces(kept, ids, 2048), 2048)
