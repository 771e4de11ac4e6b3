"""The corpus pipeline on planted documents, stage by stage, and its near-duplicate stage against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reportmill.llm import near_sets, sentencepiece, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Folder, texts by id, and the ids that are toxic, exact and near copies."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(900)]
    text = {k: " ".join(rng.choices(vocabulary, k=rng.randint(80, 400))) for k in range(300)}
    toxic = {k for k in text if k % 5 == 1}
    for k in toxic:
        text[k] += " vilest slurword" * 2
    clean = sorted(set(text) - toxic)
    exact, near = set(), set()
    for n, k in enumerate(rng.sample(clean, 30)):
        new = 1000 + n
        if n % 2:
            text[new] = text[k].replace(" ", "  ")
            text[k] += "   \n" * 400  # the longer one stays
            exact.add(new)
        else:
            w = text[k].split()
            w[len(w) // 2] = "changed"
            text[new] = " ".join(w)
            near.add(new)
    text |= {2000: None, 2001: "", 2002: "é ▁ \x00 日本"}
    exact.add(2001)
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(k, t, None if k == 3 else "en", None if k == 4 else f"s{k % 3}", k) for k, t in text.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), text, toxic, exact, near


def test_stages(spark, planted):
    path, text, toxic, exact, near = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns, gone = set(text), docs.columns, [toxic, exact, near]
    for (_, stage), lost in zip(corpus_pipeline.STAGES[:3], gone):
        docs = stage(spark, docs, path)
        kept -= lost
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(ids) == len(set(ids)) and set(ids) == kept
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= kept and max(copies.values()) <= 3
    # weights 1, 2, 3 by source, null last: the fourth again weighs 1, and no target is above three times its source's size
    size, taken = Counter(), Counter()
    for k in kept:
        source = None if k == 4 else f"s{k % 3}"
        n = len((text[k] or "").split())
        size[source] += n
        taken[source] += n * copies[k]
    weight = dict(zip(["s0", "s1", "s2", None], [1, 2, 3, 1]))
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else weight[s] * rest / sum(w for t, w in weight.items() if t not in capped) for s in weight}
        above = {s for s in weight if s not in capped and target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    assert all(abs(taken[s] - target[s]) < 0.15 * target[s] + 400 for s in weight)


def test_run(spark, planted):
    path, text, toxic, exact, near = planted
    rows = corpus_pipeline.run(spark, path).collect()
    v = sentencepiece.vocabulary()
    assert rows and not {r.doc_id for r in rows} & (toxic | exact | near)
    for r in rows:
        if text[r.doc_id] is not None:
            assert r.n_pieces == len(r.ids) and sentencepiece.decode(np.array(r.ids, int), v) == text[r.doc_id]
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    again = corpus_pipeline.run(spark, path).select("doc_id", "n_pieces").collect()
    assert Counter((r.doc_id, r.n_pieces) for r in rows) == Counter(map(tuple, again))


def test_empty(spark, planted, tmp_path):
    path = planted[0]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_similar_texts(spark, monkeypatch):
    """All texts of at least 0.9 are linked, none under 0.6; the same where every shard is cut into parts."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    text = {}
    for k, w in enumerate(base):
        for n, changes in enumerate((0, 1, 2, 15, 40)):
            w = list(w)
            for at in rng.sample(range(300), changes):
                w[at] = f"x{rng.randrange(5000)}"
            text[k * 10 + n] = " ".join(w)
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_sets.near_dedup_similar(docs).collect()}
    sets = {k: shingles(t) for k, t in text.items()}
    for a in text:
        assert a // 10 == found[a] // 10
        for b in range(a - a % 10, a):
            if b in sets:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                assert found[a] == found[b] or j < 0.9
        best = max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in text if b != a and b // 10 == a // 10)
        assert best > 0.6 or found[a] == a
    monkeypatch.setattr(near_sets, "SET_PART", 2)
    assert {r.doc_id: r.component_id for r in near_sets.near_dedup_similar(docs).collect()} == found
    assert near_sets.drop_near_copies(docs.limit(0)).count() == 0
    assert near_sets.drop_near_copies(docs.withColumn("fp", F.lit(1)).withColumn("row", F.lit(2))).columns == ["doc_id", "text", "fp", "row"]


def test_similar_texts_at_the_threshold(spark):
    """No link is under 0.8, and nearly all pairs of at least 0.8 are linked, brute force says; repeats do not count."""
    rng = random.Random(5)
    text = {}
    for k in range(80):
        w = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for n in range(4):
            at = rng.randrange(250)
            text[k * 10 + n] = " ".join(w[:at] + [f"x{rng.randrange(4000)}" for _ in range(rng.randrange(60))] + w[at + rng.randrange(30) :])
    same = "one line that is there again and again "
    text |= {9000: same * 300 + text[0], 9001: same * 300 + text[10]}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_sets.near_dedup_similar(docs).collect()}
    sets = {k: shingles(t) for k, t in text.items()}
    pairs = [(a, b) for a in text for b in text if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    true = simhash.roots(10_000, *np.array(pairs).T)
    assert len(pairs) > 50 and all(true[k] == true[found[k]] for k in text)
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_forest():
    rng = np.random.default_rng(1)
    i, j, d = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 20, 400)
    label, weight = list(range(60)), 0
    for k in np.argsort(d, kind="stable"):
        a, b = label[i[k]], label[j[k]]
        if a != b:
            weight += d[k]
            label = [a if x == b else x for x in label]
    kept = simhash.forest(60, i, j, d)
    assert d[kept].sum() == weight and len(kept) == 60 - len(set(label))


def test_one_row_of_each_component_stays(spark):
    """Ids that are null or repeated: what stays is one row of each component, never less."""
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(30)]
    near = [w[:50] + ["x"] + w[51:] for w in texts]
    a, b, c = (" ".join(w) for w in texts[:3])
    plus = " ".join(near[0])

    def kept(rows):
        return Counter(map(tuple, near_sets.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))

    assert kept([(1, a), (5, plus), (5, b), (7, c)]) == Counter([(1, a), (5, b), (7, c)])
    assert kept([(1, plus), (1, a), (1, b)]) in (Counter([(1, x), (1, b)]) for x in (a, plus))
    assert kept([(None, a), (None, plus), (None, b), (9, plus), (None, None), (3, "")]) == Counter([(9, plus), (None, b), (3, "")])
    rows = [(rng.choice([None, 1, 2, 3, k]), " ".join(rng.choice([texts, near])[k])) for k in range(30) for _ in range(rng.randint(1, 4))]
    found = kept(rows)
    best = {}
    for i, t in rows:
        k = next(k for k in range(30) if t in (" ".join(texts[k]), " ".join(near[k])))
        best[k] = min(best.get(k, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in found.elements()) == sorted(best.values()) and len({t for _, t in found}) == 30
