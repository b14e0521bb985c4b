"""Ranked lexical search and whitening against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from reqweave.llm import fptree, whitening
from reqweave.llm.common import start

ITEM_SCHEMA = "item_id long, text string, doc_id long, n long, rank int, score long, key long"


def plain_terms(text):
    keep = lambda c: ord(c) > 127 or c.isalnum()
    low = "".join((c.lower() if ord(c) < 128 else c) if keep(c) else " " for c in text or "")
    return [w for w in low.split(" ") if w]


def plain_ranking(docs, items, top=20):
    counted = [(i, Counter(plain_terms(t))) for i, t, *_ in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 75 + 25 * n * big // length
            score = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(*i, 1, 2, 3, 4, 5) for i in items], ITEM_SCHEMA)


@pytest.mark.parametrize(("leaf", "cells", "block"), [(32, 8 << 20, 512), (1, 8 << 20, 2), (4, 200, 3), (2, 2000, 512)])
def test_ranking_against_all_documents(spark, monkeypatch, leaf, cells, block):
    start(spark)
    for name, value in (("LEAF", leaf), ("TREE_CELLS", cells), ("ITEMS", block)):
        monkeypatch.setattr(fptree, name, value)
    data = rows()
    items = [(k, data[k * 7][1]) for k in range(8)] + [(50, None), (51, ""), (52, "?! --"), (53, "the the the THE of"), (54, "straße SCHÖN Schön x123 changed61"), (54, "one two words"), (55, "nowhere0")]
    got = fptree.best_documents(frame(spark, data), items_frame(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_ranking(data, items)


def test_ties_and_many_copies(spark):
    start(spark)
    rng = random.Random(5)
    data = [(k, "same words in every copy", "en", "s") for k in rng.sample(range(10**6), 300)] + [(None, "same words in every copy", "en", "s"), (-5, "other", "en", "s")]
    items = [(1, "copy words"), (2, "other same")]
    got = fptree.best_documents(frame(spark, data), items_frame(spark, items))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_ranking(data, items)


def test_empty_searches(spark):
    start(spark)
    assert fptree.best_documents(empty(spark), items_frame(spark, [(1, "a")])).count() == 0
    assert fptree.best_documents(frame(spark), items_frame(spark, []).limit(0)).count() == 0


def test_bounds_leave_documents_out():
    """A rare term is found without a look at the documents that lack it."""
    rng = np.random.default_rng(2)
    n, width = 2000, 40
    tf = (rng.random((n, width)) < 0.9 ** np.arange(width)).astype(np.int32)
    tf[:, -1] = 0
    tf[[5, 900], -1] = 3
    owner, terms = np.nonzero(tf)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    tree = fptree.Tree(np.arange(n), np.full(n, 100), offsets, terms, tf[owner, terms], np.arange(width))
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[0], slice):
                seen.append(key[0].stop - key[0].start)
            return np.asarray(super().__getitem__(key))

    tree.tf = tree.tf.view(Watched)
    assert [i for _, i in tree.search(np.array([39]), np.array([7]), [], 20)] == [5, 900]
    assert sum(seen) <= 4 * fptree.LEAF
    assert all(sum(b - a for a, b in (tree.span[c] for c in below)) == tree.span[k][1] - tree.span[k][0] for k, below in enumerate(tree.children) if below)


def plain_whitening(data, top=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in data])
    n = len(x)
    away = (n * x - x.sum(axis=0)) / n
    values, basis = np.linalg.eigh(away.T @ away / n)
    values, basis = values[::-1][:top], basis[:, ::-1][:, :top]
    real = values > 1e-12 * values[0]
    dev = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    return away @ basis[:, real] / np.sqrt(values[real]), values[real] / (away**2).sum() * n, dev


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 4, 1.0, 2) for i, v in data], "vec_id long, embedding array<double>, n long, whitened double, component int").repartition(3)


@pytest.mark.parametrize(("n", "d", "rank"), [(400, 100, 100), (300, 12, 12), (200, 80, 5), (20, 60, 60)])
def test_whitening_against_a_plain_eigensolver(spark, n, d, rank):
    start(spark)
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, rank)) @ (rng.normal(size=(rank, d)) * np.linspace(3, 0.2, rank)[:, None])
    if rank < d:  # whole after scaling, so that the rank holds
        x = np.round(rng.integers(-9, 9, size=(n, rank)) @ rng.integers(-3, 4, size=(rank, d))).astype(float)
    good = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * (d - 2)), (903, [float("nan")] * d), (904, [float("inf")] * d), (905, [1.0])]
    got = whitening.whiten(vectors(spark, good + bad)).toPandas()
    want, explained, dev = plain_whitening(good)
    k = want.shape[1]
    assert set(got.vec_id) == {i for i, _ in good}
    got = got.sort_values(["vec_id", "component"])
    assert (got.component.to_numpy().reshape(n, k) == np.arange(1, k + 1)).all()
    mine = got.whitened.to_numpy().reshape(n, k)
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * sign).max() < 1e-7
    assert np.abs(got.explained.to_numpy()[:k] / explained - 1).max() < 1e-9
    assert got.identity_error.max() < 1e-9 and set(got.n) == {n}
    assert got.deviation.to_numpy().reshape(n, k)[:, 0].tolist() == dev


def test_whitening_without_variance(spark):
    start(spark)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, []).limit(0)).count() == 0
    two = whitening.whiten(vectors(spark, [(None, [1.0, 2.0]), (3, [1.0, 5.0]), (3, [1.0, 5.0])])).collect()
    assert sorted((r.vec_id is None, r.component) for r in two) == [(False, 1), (False, 1), (True, 1)]


def test_filter_damps_the_lower_spectrum():
    values = np.concatenate([np.linspace(10, 6, 8), np.linspace(5, 0, 60)])
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(68, 68)))[0]
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return (basis * values) @ (basis.T @ block)

    found, kept = whitening.leading(product, 68, 8)
    assert np.abs(found - values[:8]).max() < 1e-10 and np.abs(np.abs((basis[:, :8] * kept).sum(axis=0)) - 1).max() < 1e-10
    assert set(passes) == {16} and len(passes) < 150


def test_deviations_of_any_size():
    x, n = np.array([[2**40, 5], [0, 5]]), 2
    assert whitening.deviations(x, n, x.sum(axis=0)) == [2**80, 2**80]
