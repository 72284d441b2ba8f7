"""Phrases against brute force: pieces, languages, covers, cuts, ties and the dynamic counts."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexishift.llm import phrases


def brute(docs, least=30, longest=4, top=2000):
    f, words = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            held = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    held[tuple(w[i : i + k])] += 1
    rows = []
    for lang, held in f.items():
        found = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * b >= 80 * found[q]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (held[p[:k]] + held[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(rows)


def told(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def frame(spark, docs):
    return spark.createDataFrame(docs, "lang string, text string")


def texts(n, seed, words=25):
    rng = np.random.default_rng(seed)
    names = [f"{c}{d}" for c in "abcdé" for d in ("", "x", "Ü", "漢", "Q")][:words]
    out = []
    for _ in range(n):
        parts = []
        for i in rng.zipf(1.3, rng.integers(0, 80)) % words:
            parts.append(names[i])
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n"], p=[0.8, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02]))
            if rng.random() < 0.1:
                parts.append("to be or not ")
        out.append((rng.choice(["en", "de", ""]), "".join(parts)))
    return out


@pytest.mark.parametrize("shards,least,longest,top", [(3, 30, 4, 2000), (1, 5, 4, 7), (5, 2, 3, 2000), (2, 4, 6, 50)])
def test_all_phrases_are_found(spark, shards, least, longest, top):
    docs = texts(120, shards)
    got = phrases.collocations(frame(spark, docs), least=least, longest=longest, shards=shards, top=top)
    assert told(got) == brute(docs, least, longest, top)


def test_nulls_repeats_and_other_columns(spark):
    docs = [(None, "New York. New York, new york")] * 15 + [("und", "new york is new york")] * 10 + [("en", None), ("en", ""), ("fr", " \t "), ("en", ".,;")] + [("en", "w" * 5000 + " " + "v" * 3000)] * 31
    got = phrases.collocations(frame(spark, docs).withColumn("name", F.lit(1)).withColumn("shard", F.lit(2)))
    assert told(got) == brute(docs)


def test_no_rows(spark):
    assert told(phrases.collocations(frame(spark, []))) == []


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GROUP_BYTES", 50)
    docs = texts(40, 9)
    assert told(phrases.collocations(frame(spark, docs), least=3)) == brute(docs, 3)


def test_a_full_filter_and_shared_names_change_nothing(spark, monkeypatch):
    """Every name collides with many others in a filter of eight bits, and words share hashes."""
    monkeypatch.setattr(phrases, "FEW_BITS", 3), monkeypatch.setattr(phrases, "MOST_BITS", 3)
    docs = texts(60, 11)
    assert told(phrases.collocations(frame(spark, docs), least=8)) == brute(docs, 8)


def test_phrases_with_one_name_are_told_apart():
    """Where the first hash of all words is the same, the second still parts them."""
    tokens = phrases.Tokens([b"ab cd ab", b"cd"], b"en")
    assert len({*zip(tokens.word.tolist(), tokens.check.tolist(), strict=True)}) == 2
    named, places = phrases.Named(), np.arange(4)
    for _ in range(2):
        named.add(tokens, 1, places, np.full(4, 7, np.uint64), tokens.check)
    rows = named.batch("en", 1).to_pylist()
    assert sorted((r["phrase"], r["n"]) for r in rows) == [("ab", 4), ("cd", 4)]
    named.add(tokens, 1, places, np.full(4, 7, np.uint64), tokens.check)
    assert [r["phrase"] for r in named.batch("en", 1).to_pylist()] == [None, None]  # texts are told once


def test_arithmetic_beyond_64_bits(spark):
    """2,000,000 times a count of the size of a whole crawl no longer fits 64 bits."""
    a = 2**62
    row = spark.sql(f"select cast(cast({a}L as decimal(20,0)) * 2000000 div (cast({a}L as decimal(20,0)) + {a}L) as bigint) as s").first()
    assert row.s == 1_000_000


def mirrored(rounds):
    """Two words of 2 ** rounds letters whose sums of letters times powers are equal modulo 2 ** 64, whatever the letters' values and the (odd) base, from 10 rounds on."""
    x, y = "a", "b"
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_words_made_to_share_sums_of_powers_are_told_apart(spark):
    docs = []
    for rounds in (10, 11):
        x, y = mirrored(rounds)
        docs += [("en", f"{x} up")] * 31 + [("en", f"{y} up")] * 37 + [("en", f"see {x}. go")] * 40
    assert told(phrases.collocations(frame(spark, docs))) == brute(docs)


def test_words_of_other_bytes_have_other_names():
    words = [b"a" * n for n in range(1, 40)] + [b"a" * n + b"\0" for n in range(39)] + ["é漢"[k % 2 :].encode() * (k + 1) for k in range(9)] + [w.encode() for w in mirrored(10)]
    tokens = phrases.Tokens([b" ".join(words)], b"en")
    assert len({*zip(tokens.word.tolist(), tokens.check.tolist(), strict=True)}) == len({*words}) == len(tokens.word)
    again = phrases.Tokens([b"x," + b" ".join(words[::-1])], b"en")
    assert again.word[1:].tolist() == tokens.word[::-1].tolist() and again.check[1:].tolist() == tokens.check[::-1].tolist()
    assert not {*phrases.Tokens([b" ".join(words)], b"de").word.tolist()} & {*tokens.word.tolist()}
