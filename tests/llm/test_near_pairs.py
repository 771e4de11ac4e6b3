"""The near-duplicate stage finds every pair of at least 0.8, brute force says."""

import random

import numpy as np
from pyspark.sql import types as T

import corpus_pipeline
from reportmill.llm import jaccard_join, near_sets, simhash

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string")


def some_words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def linked(spark, text):
    return {r.doc_id: r.component_id for r in near_sets.near_dedup_similar(spark.createDataFrame(list(text.items()), SCHEMA)).collect()}


def brute_force(text):
    sets = [shingles(t) for t in text.values()]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    ids = list(text)
    label = simhash.roots(len(ids), *np.array(pairs).T)
    return {ids[k]: min(ids[x] for x in np.flatnonzero(label == label[k])) for k in range(len(ids))}


def test_all_pairs_at_the_threshold(spark):
    rng, text = random.Random(21), {}
    for k in range(150):
        w = some_words(rng, 200)
        text[2 * k], text[2 * k + 1] = " ".join(w), " ".join(w[:-21] + some_words(rng, 21))  # 175 of 217 shingles
    found = linked(spark, text)
    assert all(found[2 * k + 1] == 2 * k for k in range(150)) and found == brute_force(text)


def test_links_within_a_family_just_under_the_threshold(spark):
    rng, text = random.Random(22), {}
    template = some_words(rng, 260)
    for k in range(300):
        own = some_words(rng, 40)
        text[k] = " ".join(template + own)  # 256 of 336 shingles with any other
        if k % 10 == 0:
            text[1000 + k] = " ".join(template + own[:-30] + some_words(rng, 30))  # 266 of 326
    found = linked(spark, text)
    assert all(found[1000 + k] == k for k in range(0, 300, 10)) and found == brute_force(text)


def test_short_texts(spark):
    rng, text = random.Random(23), {}
    for k in range(150):
        w = some_words(rng, 9)
        text[2 * k], text[2 * k + 1] = " ".join(w[:8]), " ".join(w)  # 4 of 5 shingles
    found = linked(spark, text)
    assert all(found[2 * k + 1] == 2 * k for k in range(150)) and found == brute_force(text)


def test_links_through_rows_without_an_id(spark):
    rng, rows = random.Random(24), []
    for k in range(20):
        w, new = some_words(rng, 200), some_words(rng, 40)
        rows += [(2 * k, " ".join(w)), (None, " ".join(w[:-20] + new[:20])), (2 * k + 1, " ".join(new[20:] + w[20:-20] + new[:20]))]
    found = near_sets.near_dedup_similar(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert len(found) == 60 and all(by_id[2 * k] == by_id[2 * k + 1] == 2 * k for k in range(20))


def test_the_near_stage_drops_what_simhash_links(spark):
    """Lines that are there again and again fill the fingerprints, while few of the distinct shingles are shared."""
    rng, same = random.Random(25), "one line that is there for ever "
    text = {k: same * 300 + " ".join(some_words(rng, 300)) for k in (4, 2)} | {9: " ".join(some_words(rng, 300))}
    assert linked(spark, text) == {k: k for k in text}
    docs = spark.createDataFrame(list(text.items()), SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near(spark, docs, "").collect()} == {2, 9}


def test_large_groups_of_near_copies_are_moved_in_proportion(spark, monkeypatch):
    """Every pair of parts of a group would be 100 sets to each of 50 parts."""
    rng, moved, solved = random.Random(26), [], jaccard_join._solved
    template = some_words(rng, 200)
    text = {k: " ".join([*template[:k], f"x{k}", *template[k + 1 :]]) for k in range(100)}

    def counted(placed, *args):
        moved.append(placed.count())
        return solved(placed, *args)

    monkeypatch.setattr(jaccard_join, "_solved", counted)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(near_sets, "SET_PART", 2)
    assert set(linked(spark, text).values()) == {0} and len(moved) > 0 and sum(moved) < 500
