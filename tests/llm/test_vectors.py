"""Embeddings against brute force: counts, components, ties, nulls, copies, dimensions and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexishift.llm import vectors


def brute(rows, similarity=0.9):
    """(vec_id, n_links, component_id, kept) of every row, sorted."""
    unit = {}
    for r, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            unit[r] = x / np.sqrt((x * x).sum())
    links = {r: [s for s in unit if s != r and len(unit[s]) == len(unit[r]) and unit[r] @ unit[s] >= similarity] for r in unit}
    out = []
    for r, (i, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for s in links.get(todo.pop(), []):
                if s not in seen:
                    seen.add(s), todo.append(s)
        c = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(links.get(r, [])), c, c is None or c == i))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def planted(n, dim, seed, groups=6):
    """Random vectors, copies, noisy copies just above and below the similarity, and a chain."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(groups):
        for k in range(1, 9):
            x[g * 10 + k] = x[g * 10] if k < 3 else x[g * 10] + rng.normal(size=dim) * rng.uniform(0.1, 0.6)
    for k in range(1, 6):
        x[-k - 1] = x[-k] + rng.normal(size=dim) * 0.35
    order = rng.permutation(n)
    return [(int(i), x[j].tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize("dim,block,leaf", [(64, 2048, 128), (64, 37, 16), (7, 29, 8), (3, 50, 10), (1, 16, 128)])
def test_every_pair_is_found(spark, monkeypatch, dim, block, leaf):
    monkeypatch.setattr(vectors, "BLOCK", block), monkeypatch.setattr(vectors, "LEAF", leaf)
    rows = planted(300, dim, dim)
    assert told(vectors.near_vectors(frame(spark, rows))) == brute(rows)


def test_other_similarities(spark):
    rows = planted(200, 16, 5)
    for s in (0.5, 0.99, 1.0):
        got = told(vectors.near_vectors(frame(spark, rows), similarity=s))
        assert got == brute(rows, s) if s < 1 else [x[1] for x in got] != []
    with pytest.raises(ValueError):
        vectors.near_vectors(frame(spark, rows), similarity=0)


def test_nulls_ties_copies_dimensions_and_sizes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (3, [0.0, 5.0]), (4, [1e300, 1e299]), (5, [1e-300, 1e-301]), (6, None), (7, []), (8, [0.0, 0.0]), (9, [None, 1.0]),
        (10, [nan, 1.0]), (11, [inf, 1.0]), (None, [1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1.0, 0.0, 0.0]), (14, [-1.0, 0.0]), (-5, [3.0, 0.1]), (3, [2.0, 0.0]), (15, [1.0]), (16, [-1.0]), (17, [4.0]),
    ]
    got = vectors.near_vectors(frame(spark, rows).withColumn("a", F.lit(1)).withColumn("rep", F.lit(2)))
    assert told(got) == brute(rows)


def test_no_rows_or_no_direction(spark):
    assert told(vectors.near_vectors(frame(spark, []))) == []
    assert told(vectors.near_vectors(frame(spark, [(1, [0.0]), (2, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_third_are_near_copies(spark, monkeypatch):
    """A group that spans many blocks is one component, counted in full."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    x = np.concatenate([base + rng.normal(size=(200, 32)) * 0.25, np.repeat(base[None], 100, 0), rng.normal(size=(300, 32))])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert told(vectors.near_vectors(frame(spark, rows))) == brute(rows)


def test_bounds_never_drop_a_link():
    """Of all pairs of a tile, leading axes drop none that reaches the similarity, whatever the axes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)) * np.linspace(3, 0.1, 24)
    x[200:] = x[:200] + rng.normal(size=(200, 24)) * rng.uniform(0, 0.5, (200, 1))
    unit = vectors.unit_rows(x.ravel(), 24)
    for axes in (vectors.Axes(unit[:50], 24), vectors.Axes(None, 24)):
        a, b = (vectors.Block(np.arange(len(u)), np.ones(len(u), np.int64), u, axes) for u in (unit[:150], unit[150:]))
        i, j = vectors.linked(a, b, 0.9)
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*map(list, np.nonzero(unit[:150] @ unit[150:].T >= 0.9)), strict=True)}
