"""Similar sets, the audit of filters and runs of words, against brute force, with nulls, ties, repeated rows and empty tables."""

import random
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import filter_audit, jaccard_join, periodic

CLASHING = "doc_id long, text string, source string, g int, h int, fp string, n int, row int, mask int, docs int, runs string"


def clashing(spark, rows):
    """rows: (doc_id, text, source), with extra columns that are named as the operators' own."""
    return spark.createDataFrame([(*r, 1, 1, "x", 1, 1, 1, 1, "x") for r in rows], CLASHING)


def split(text):
    return (text or "").encode().split()


# Similar sets


def shingles(text, k=3):
    w = [x.lower() for x in split(text)]
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, similarity=0.9):
    """(id, n, component) of every row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return Counter((k, len(s), least.get(x) if s else k) for (k, _), s, x in zip(rows, sets, label, strict=True))


def near_texts(rng, families, members, words=60, base=0):
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    rows = []
    for f in range(families):
        text = rng.choices(vocabulary, k=words)
        for m in range(members):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((base + f * members + m, " ".join(own)))
    return rows


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_similar_sets_corners(spark):
    rng = random.Random(3)
    rows = near_texts(rng, 6, 12) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one two three"), (907, "x " * 4000), (908, "x x x")]
    rows += [(None, rows[0][1]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (5, rows[40][1]), (1000, rows[40][1].upper() + "\n")]
    # Exactly at the threshold: 9 of 10 shingles, and just under it.
    w = [f"w{k}" for k in range(20)]
    rows += [(2000, " ".join(w[:12])), (2001, " ".join(w[:11])), (2002, " ".join(w[:10])), (2003, " ".join([*w[:11], "else"]))]
    got = jaccard_join.jaccard_classes(clashing(spark, [(k, t, "s") for k, t in rows]))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and result(got) == classes(rows)
    assert jaccard_join.jaccard_classes(clashing(spark, [])).count() == 0
    assert result(jaccard_join.jaccard_classes(clashing(spark, [(1, None, None), (None, "", None)]))) == Counter([(1, 0, 1), (None, 0, None)])


def test_large_groups_are_cut_without_loss(spark, monkeypatch):
    """Parts of a few sets: near copies that link over the shared sets, families that only resemble each other, and a chain."""
    monkeypatch.setattr(jaccard_join, "SET_PART", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(4)
    rows = near_texts(rng, 1, 90) + near_texts(rng, 3, 25, words=100, base=200)
    # Families with a common head, so that they share prefixes but are less similar than it takes; within them a chain of small steps.
    head = [f"h{k}" for k in range(90)]
    rows += [(400 + k, " ".join([*head, *[f"t{(k + i) // 2}" for i in range(14)]])) for k in range(40)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == classes(rows)


@pytest.mark.parametrize("similarity, shingle", [(0.5, 3), (0.8, 3), (1.0, 3)])
def test_other_thresholds(spark, similarity, shingle):
    rows = near_texts(random.Random(5), 5, 10, words=25)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity, shingle)
    assert result(got) == classes(rows, similarity)


def test_pairs_share_prefixes_under_all_orders():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 40, dtype=np.int64)).view(np.uint64)
        b = np.unique(np.concatenate([a[2:], rng.integers(0, 2**63, 1, dtype=np.int64).view(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert both >= 0.9 * (len(a) + len(b) - both)
        none = np.zeros((2, 0), np.int64)
        for firsts in zip(*[jaccard_join.further(x, none, 0.9) for x in (a, b)], strict=True):
            assert len(np.intersect1d(*firsts))
        own, more, free = jaccard_join.first_shingles(a, np.zeros(len(a), np.int64), 0.9)
        assert len(more) == max(0, free) and len(own) + free == jaccard_join.prefix_length(len(a), 0.9) and not len(np.intersect1d(own, more))


def test_ties_across_tasks(spark):
    """One shingle that all sets have is dealt to several tasks, and its chain does not break between them."""
    rows = [(0, 7, 100 + k // 50, k) for k in range(500)]
    postings = spark.createDataFrame(rows, "g long, h long, n long, fp long").repartition(4)
    edges = {(r.a, r.b) for r in jaccard_join.tied(postings, 0.9).collect()}
    assert edges >= {(k, k + 1) for k in range(499)} and len(edges) < 510


# Audit of filters


def audited(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    ids = {}
    for k, t, _ in rows:
        if k is not None:
            ids[t or ""] = min(k, ids.get(t or "", k))
    docs = []
    for k, t, s in rows:
        t = t or ""
        w = split(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > ids[t]}
        docs.append((s or "", fails, k in good, k in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                here = [(d, any(d[1][x] for x in order[: step - 1])) for d in docs if d[0] == part]
                removed = [d for d, gone in here if d[1][c] and not gone]
                shapley[c] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not d[1][c] and not gone for d, gone in here), len(removed), sum(d[1][c] and gone for d, gone in here), sum(d[1][c] and sum(d[1].values()) == 1 for d, _ in here),
                    sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[c])
    return out


def test_audit_by_definition(spark):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(60)] + ["LOUD", "ab#c", "x|y", "Über"]
    rows = [(k, " ".join(rng.choices(vocabulary[: rng.choice([10, 60, 64])], k=rng.choice([3, 49, 50, 51, 70]))), rng.choice(["a", "b", None, ""])) for k in range(80)]
    rows += [(100 + k, rows[k][1], rng.choice("ab")) for k in range(20)] + [(-1, rows[30][1], "c"), (7, rows[7][1], "a"), (8, rows[30][1], "a")]
    rows += [(200, None, "a"), (201, "", "b"), (None, "", "a"), (None, rows[3][1], None), (None, "LOUD#", "b"), (202, "Q" * 100_000, "a"), (203, "w " * 50_000, "b")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 210, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("good", F.lit("x"))
    got = filter_audit.audit_filters(clashing(spark, rows), frame)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got.collect()} == audited(rows, labels)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.audit_filters(clashing(spark, []), frame).count() == 0


def test_audit_of_other_filters(spark):
    """Any cells and letters; what all filters fail is redundant but for the first."""
    cells = spark.createDataFrame([("p", 3, 5, 2, 1), ("p", 0, 7, 0, 0), ("p", 1, 2, 0, 0)], "part string, mask int, docs long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(cells, "XY").collect()}
    assert len(got) == 4
    assert (got["XY", 1].removed, got["XY", 1].kept, got["XY", 2].removed, got["XY", 2].redundant, got["YX", 2].removed) == (7, 7, 0, 5, 2)
    assert (got["XY", 1].shapley, got["XY", 2].shapley, got["XY", 1].unique_fails, got["YX", 1].good_lost) == (9, 5, 2, 2)


# Runs


def all_runs(w, least=12):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, 2 * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def texts_with_runs(rng, n):
    out = []
    for _ in range(n):
        letters = "abcdefghijklmnop"[: rng.choice([1, 2, 3, 16])]
        w = rng.choices(letters, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            period = rng.choices(letters, k=rng.randint(1, 20))
            w += (period * 12)[: rng.randint(0, 12 * len(period))] + rng.choices(letters, k=rng.randint(0, 10))
        out.append(" ".join(w))
    return out


def test_runs_by_definition(spark):
    rng = random.Random(9)
    texts = texts_with_runs(rng, 300) + [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 6, "a b c d e f " * 2, "a b c d e f g " * 2, ("fib " + "onacci fib " * 3) * 8]
    a, b = "a", "a b"
    for _ in range(9):  # Fibonacci words hold many runs
        a, b = b, f"{b} {a}"
    texts += [b, " ".join(f"w{k}" for k in range(20_000)), "x y " * 30_000, " ".join(f"w{k % 777}" for k in range(5000))]
    rows = [(None if k % 7 == 0 else k // 2, t, "s") for k, t in enumerate(texts)]
    got = periodic.periodic_runs(clashing(spark, rows))
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = Counter((r.doc_id, str([tuple(x) for x in r.runs]), r.collapsed) for r in got.collect())
    want = Counter()
    for k, t, _ in rows:
        w = split(t)
        runs = [(0, 60_000, 2)] if len(w) == 60_000 else [] if len(w) == 20_000 else all_runs(w)
        want[k, str(runs), collapsed(w, runs)] += 1
    assert found == want
    assert periodic.periodic_runs(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("least", [2, 5, 12, 31])
def test_runs_of_other_lengths(least):
    rng = random.Random(least)
    for t in texts_with_runs(rng, 60):
        w = split(t)
        ids = np.array([sorted(set(w)).index(x) for x in w], np.int64)
        got = periodic.runs_of(ids, np.array([0, len(w)]), least)
        assert [tuple(map(int, x)) for x in zip(*got, strict=True)] == all_runs(w, least)


def test_repeated_tails(spark):
    rows = [(h, " ".join(f"w{k}" for k in range(n))) for h in (0, 10, 130, 1270, 99990, 7, 4294967290) for n in (0, 1, 2, 13, 50)] + [(10, None), (10, " \n"), (None, "a  b"), (3, "a  b")]
    got = spark.createDataFrame(rows, "h long, text string").select("h", "text", periodic.repeat_tail(F.col("text"), F.col("h")).alias("x")).collect()
    for r in got:
        w, want = (r.text or "").split(), r.text
        if r.h is not None and r.h % 10 == 0 and w:
            g = r.h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            want = " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))
        assert r.x == want
