"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexishift.llm import variants


def counted(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = counted(docs)
    forms, out = {}, {}
    for w in n:
        close = [v for v in n if v != w and apart(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n[w], out[w], n[forms[w]] if forms[w] else None))
    return sorted(rows)


def told(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def noisy(n_docs, seed, letters="abcdeéñz", stems=40):
    rng = np.random.default_rng(seed)
    stem = ["".join(rng.choice(list(letters), rng.integers(4, 10))) for _ in range(stems)]
    docs = []
    for d in range(n_docs):
        words = []
        for s in rng.zipf(1.4, 120) % stems:
            w = list(stem[s])
            for _ in range(rng.integers(0, 3) if rng.random() < 0.5 else 0):
                at, kind = rng.integers(0, len(w)), rng.integers(0, 3)
                w[at : at + (kind > 0)] = [rng.choice(list(letters))] if kind < 2 else []
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        docs.append((d, rng.choice([" ", "-", "漢", " ", "'"]).join(words)))
    return docs


@pytest.mark.parametrize("home,visitors,groups", [(2048, 16384, 6), (5, 7, 3), (3, 4, 1)])
def test_every_near_pair_is_found(spark, monkeypatch, home, visitors, groups):
    for name, value in (("HOME", home), ("VISITORS", visitors), ("GROUPS", groups)):
        monkeypatch.setattr(variants, name, value)
    table = variants.balanced_groups
    monkeypatch.setattr(variants, "balanced_groups", lambda w: table(w, groups))
    docs = noisy(60, groups)
    assert told(variants.variants(frame(spark, docs))) == brute(docs)


def test_nulls_long_words_ties_and_other_columns(spark):
    long = "ab" * 3000
    docs = [
        (1, None), (2, ""), (None, "horse horse horse"), (3, "house house house horse"), (4, f"{long} {long}c {long}"), (5, f"{long} {long}c {long}c"), (6, "abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg"), (6, "ÀÀÀÀÀ àÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀ àÀÀÀÀ àÀÀÀÀ"),
        (7, "x" * 1100 + " " + "x" * 1100 + " " + "x" * 1100 + " " + " ".join(["x" * 1101] * 6)), (8, "×÷×÷× ×÷×÷× ×÷×÷×"), (9, "ab cd ab cd ab"), (9, "ab cd ab cd ab"),
    ]
    got = variants.variants(frame(spark, docs).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)))
    assert told(got) == brute(docs)


def test_no_rows(spark):
    assert told(variants.variants(frame(spark, []))) == []


def test_chains_lead_to_their_last_form(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    docs = [(i, " ".join([w] * (3 * 2**k + 40 * (k > 3)))) for i in range(3) for k, w in enumerate(words)]
    rows = brute(docs)
    assert told(variants.variants(frame(spark, docs))) == rows
    assert len({r[2] for r in rows}) < len(rows) - 3


def test_one_edit():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(150)]
    h = variants.Words(words, max(map(len, words)))
    i, j = variants.near(h, h, True)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if apart(words[a], words[b])}
    both = {(a, b) for a, b in want if len(words[a]) >= len(words[b])}  # in a tile the home words are the longer
    assert both <= {*zip(i.tolist(), j.tolist(), strict=True)} <= want
