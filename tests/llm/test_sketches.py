"""Sketches part groups of sets before whole sets are moved, and lose no link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm import jaccard_join, near_sets, simhash

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string")


def some_words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_sets_that_meet_by_chance_are_not_moved_whole(spark, monkeypatch):
    """Every text has half of its shingles from a template, two are near copies."""
    rng, moved, solved = random.Random(31), [], jaccard_join._solved
    template = some_words(rng, 200)
    text = {k: " ".join(template + some_words(rng, 200)) for k in range(60)}
    text[100] = text[7] + " changed"

    def counted(placed, *args):
        moved.append(placed.agg(F.sum(sum(F.length(c) for c, kind in placed.dtypes if kind == "binary"))).first()[0] or 0)
        return solved(placed, *args)

    monkeypatch.setattr(jaccard_join, "_solved", counted)
    found = {r.doc_id: r.component_id for r in near_sets.near_dedup_similar(spark.createDataFrame(list(text.items()), SCHEMA)).collect()}
    assert found == {k: 7 if k == 100 else k for k in text}
    whole = 8 * sum(len(t.split()) - 4 for t in text.values())
    assert 0 < sum(moved) < whole / 8


def some_set(rng, n):
    return rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_sketches_lose_no_link(monkeypatch, similarity):
    """Families of sizes around powers of 2, where sketches are folded, and sets beyond the widest sketch."""
    rng = np.random.default_rng(7)
    for most in (1 << 17, 128):
        monkeypatch.setattr(jaccard_join, "SKETCH_BITS", (64, most))
        sets = [np.zeros(0, np.uint64), some_set(rng, 1), some_set(rng, 2)]
        for n in (5, 60, 64, 66, 127, 129, 250, 257, 520):
            base = np.unique(some_set(rng, n))
            sets.append(base)
            for _ in range(6):
                kept = rng.permutation(base)[: n - rng.integers(0, 1 + n // 3)]
                sets.append(np.unique(np.concatenate([kept, some_set(rng, int(rng.integers(0, 1 + n // 4)))])))
        order = rng.permutation(len(sets))
        sets = [sets[k] for k in order]
        n = np.array([len(x) for x in sets])
        edges = jaccard_join.fitting_sketches([jaccard_join.sketch(x) for x in sets], n, similarity, np.arange(len(sets)))
        label = simhash.roots(len(sets), *np.array(edges, np.int64).reshape(-1, 2).T)
        links = 0
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if n[a] and n[b] and both >= similarity * (n[a] + n[b] - both) - 1e-9:
                    links += 1
                    assert label[a] == label[b]
        assert links > 0 or similarity == 1.0
        assert len(edges) == len(sets) - len(set(label.tolist()))
        # What is in one class already gets no edge.
        assert jaccard_join.fitting_sketches([jaccard_join.sketch(x) for x in sets], n, similarity, np.zeros(len(sets), np.int64)) == []


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 3, 64, 65, 100, 1000):
        a = np.unique(some_set(rng, n))
        b = np.unique(np.concatenate([a[n // 3 :], some_set(rng, 2 * n)]))
        x, y = jaccard_join.sketch(a)[None], jaccard_join.sketch(b)[None]
        words = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard_join.folded(x, words) ^ jaccard_join.folded(y, words)).sum() <= len(np.setxor1d(a, b))
        assert len(a) <= 64 * x.shape[1] and (x.shape[1] == 1 or 32 * x.shape[1] < len(a))
