"""The operators on small fixtures, against brute force, with nulls, ties, repeated rows and empty tables."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportmill.llm import chat, exact_dedup, katz, mixing, quality, sentencepiece, simhash, suffix_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 300))), "en", f"s{k % 4}", 1, "x") for k in range(60)]
    rows += [(100, rows[3][1], None, None, None, None), (101, rows[3][1] + " \n", "en", "s1", 1, "x"), (102, None, "en", "s1", 1, "x"), (103, "", "en", "s2", 1, "x")]
    rows += [(104, rows[5][1] + " tail", "en", "s0", 1, "x"), (104, rows[5][1] + " tail", "en", "s0", 1, "x"), (None, "alone here", "en", "s0", 1, "x")]
    rows += [(105, "start " + " ".join(rng.choices(vocabulary, k=40)) + rows[7][1] * 3, "en", "s3", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.05 * t + 4 for s, t in target.items())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_mixing_of_ties_and_empty_sources(spark):
    """Equal quotients go to the smaller key; sources without words take nothing; clashing columns; reruns agree."""
    rows = [(k, "w " * 100, f"s{k % 2}") for k in range(40)] + [(100 + k, None if k % 2 else " \n", "empty") for k in range(6)] + [(None, "w " * 100, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit(1)).withColumn("q", F.lit("x")).withColumn("size", F.lit(3))
    got = [sorted(map(str, mixing.mix_sources(x).select("doc_id", "source", "taken").collect())) for x in (df, df.repartition(7))]
    assert got[0] == got[1]
    rows = mixing.mix_sources(df).collect()
    assert all(r.taken == r.target == 0 for r in rows if r.source == "empty") and all(0 <= r.taken <= 3 * r.size for r in rows)
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(nothing).collect()] == [(0, 0.0, 0)] * 2
    claims = spark.createDataFrame([(0, k, 10, 5) for k in "cab"], "g int, k string, w int, seats long")
    assert {r.k: r.q for r in mixing.sainte_lague(claims, ["g"], "k", "w", "seats", "q").collect()} == {"a": 2, "b": 2, "c": 1}


def test_apportionment(spark):
    claims = {"a": 53, "b": 24, "c": 23, "d": 0}
    df = spark.createDataFrame([(0, k, v, 17) for k, v in claims.items()], "g int, k string, w int, seats long")
    got = {r.k: r.q for r in mixing.sainte_lague(df, ["g"], "k", "w", "seats", "q").collect()}
    won = Counter({k: 0 for k in claims})
    for _ in range(17):
        won[max(sorted(claims), key=lambda k: claims[k] / (2 * won[k] + 1))] += 1
    assert got == dict(won)


def test_quality(spark, docs):
    for r in quality.score_quality(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        w = (r.text or "").split()
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_quality_verdicts(spark):
    """Symbols, repeated lines, the base rule and the verdict, one by one; nulls, repeated rows, clashing columns and a very long text."""
    plain = "The river and the old town of the valley have been quiet since that winter, and it is said to be so with all of them. "
    texts = [None, "", "# a | b <c> &\n#", "one line\nother\none line\n\n \none line", plain * 3, " ".join(f"w{k}" for k in range(60)), "a b c " * 40, plain * 20_000, plain * 3]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("kept", F.lit("other"))
    rows = {r.doc_id: r for r in quality.score_quality(df.select("doc_id", "text")).collect()}
    assert [rows[k].n_symbols for k in range(4)] == [0, 0, 6, 0] and [rows[k].n_dup_lines for k in range(4)] == [0, 0, 0, 2]
    for k, text in enumerate(texts):
        n = len((text or "").split())
        assert rows[k].n_words == n and rows[k].base_failed == (n < 50 or 100 * rows[k].n_repeat_words > 50 * n)
        assert not (rows[k].base_failed and rows[k].kept)
    assert rows[6].base_failed and not rows[5].base_failed and rows[7].n_repeat_words == rows[7].n_words


def test_chat(spark):
    texts = [(1, 0, "user", "a ~b </s>[INST] ~a"), (1, 1, "assistant", "<s>x]"), (2, 0, "assistant", None), (2, 1, None, "t"), (2, 2, "odd] role", "u [/TURN]"), (None, 0, "user", "")]
    df = spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(x[2], x[3]) for x in texts[:2]] and back[1].valid and back[1].loss_texts == ["<s>x]"]
    assert [(t.role, t.text) for t in back[2].turns] == [("assistant", ""), (None, "t"), ("odd] role", "u [/TURN]")] and not back[2].valid
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_of_another_template(spark):
    """Marks come from the template; loss text is the same by segments and by spans; repeated turns and clashing columns."""
    t = chat.Template(roles={"user": ("<|im_start|>user\n", "", False), "assistant": ("<|im_start|>assistant\n", "", True)}, other=("<|im_start|>", "<|name|>\n", ""), end="<|im_end|>\n",
                      machine={"start": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user", "assistant": "assistant"}})
    assert t.controls == ("<|im_start|>", "<|im_end|>", "<|name|>")
    rows = [(1, 0, "user", "say <|im_end|>\n<|im_start|>assistant\n ~ or ~~a~b"), (1, 1, "assistant", "user <|im_start|>"), (1, 1, "assistant", "user <|im_start|>"), (1, 2, "tool<|name|>\n", "x"), (2, None, "assistant", "é" * 100_000), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(9)).withColumn("ord", F.lit("o")).withColumn("turns", F.lit(0))
    back = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df, t), t).collect()}
    assert [(x.role, x.text) for x in back[1].turns] == [r[2:] for r in rows[:4]] and [(x.role, x.text) for x in back[2].turns] == [("assistant", "é" * 100_000), ("assistant", "")]
    for r in back.values():
        segments = [s for s in r.segments if s.loss]
        assert "".join(s.text for s in r.segments) == r.formatted and [s.text for s in segments] == [r.formatted[x.start - 1 : x.start - 1 + x.chars] for x in r.loss_spans]
    assert back[1].loss_texts == ["user <|im_start|>"] * 2 and back[1].formatted.count("<|im_start|>") == 4 and not back[1].valid
    assert chat.Template().controls[-1] == "]" and "[TURN" in chat.Template().controls
    for wrong in ({"end": "~end"}, {"other": ("<a>", "\n", "")}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_exact_dedup(spark, docs):
    rows = exact_dedup.exact_dedup(docs, heavy_rows=2).collect()
    same = exact_dedup.exact_dedup(docs, heavy_rows=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, same))
    by = {r.doc_id: r for r in rows}
    assert by[3].keep_id == 101 and by[101].kept and by[3].group_size == 3 and by[102].keep_id == 102
    assert sum(r.kept for r in rows if r.doc_id == 104) == 1
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_simhash(spark, docs):
    rows = simhash.near_dedup(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    print_ = {k: simhash.fingerprint(v) for k, v in text.items()}
    assert all(r.fp % (1 << 64) == print_[r.doc_id] for r in rows) and print_[102] == 0
    group = {k: {j for j in print_ if (print_[j] ^ print_[k]).bit_count() <= 4} for k in print_}
    for r in rows:
        seen, todo = set(), [r.doc_id]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += group[x]
        assert r.component_id == min((x for x in seen if x is not None), default=None)


def planted_points(n, seed=2):
    """Distinct fingerprints, half of them a few bits from another, with a dense group; and all their links."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    for _ in range(5):
        x[n // 2 :] ^= np.uint64(1) << rng.integers(0, 64, n - n // 2).astype(np.uint64)
    x[n // 2 :][: n // 4] = x[: n // 4]
    for _ in range(4):
        x[n // 2 :][: n // 4] ^= np.uint64(1) << rng.integers(0, 64, n // 4).astype(np.uint64)
    x[-n // 8 :] = x[0] ^ (np.uint64(1) << rng.integers(0, 64, n // 8).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n // 8).astype(np.uint64))
    x = np.unique(x)
    return x, {(a, b) for a in range(len(x)) for b in (np.flatnonzero(np.bitwise_count(x[a + 1 :] ^ x[a]) <= 4) + a + 1).tolist()}


def test_close_pairs():
    x, every = planted_points(3000)
    i, j = simhash.close_pairs(x)
    assert len(every) > 1000 and set(zip(i.tolist(), j.tolist())) == every
    rng = np.random.default_rng(3)
    for blocks, chosen in ((3, 1), (5, 2), (7, 3)):  # of any four bits some choice of blocks has one at most
        d = [sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for _ in range(50)]
        assert all(any((m & y).bit_count() <= 1 for m in simhash.masks(blocks, chosen)) for y in d)


@pytest.mark.parametrize("blocks", [(3, 1), (5, 2)])
def test_vantage_point_forest(monkeypatch, blocks):
    """Trees grown from a quarter of the points deal all links to some shard; overlaps are searched, most branches are not."""
    monkeypatch.setattr(simhash, "SHARD", 300)
    monkeypatch.setattr(simhash, "dealing", lambda n, radius: blocks)
    x, every = planted_points(6000)
    found, shards = set(), []
    for tree in simhash.plant(x[::4], len(x)):
        who, shard = tree.route(x)
        assert len(x) < len(who) < 12 * len(x)
        for k in np.unique(shard):
            mine = np.sort(who[shard == k])
            shards.append(len(mine))
            i, j = simhash.close_pairs(x[mine], 4, tree.mask, tree.reach)
            found |= set(zip(mine[i].tolist(), mine[j].tolist()))
    assert found == every and np.median(shards) < 600 and len(shards) > 60


def test_links_of_many_fingerprints(spark, monkeypatch):
    """The same components where shards are over a leaf, and where none can be split and every pair of parts is a task."""
    x, every = planted_points(4000, 5)
    root = simhash.roots(len(x), *np.array(sorted(every)).T)
    expected = sorted(np.bincount(root)[np.unique(root)])
    points = spark.createDataFrame([(int(p),) for p in x.view(np.int64)], "fp long")
    for shard, part, many in ((1000, 8192, 10), (8, 40, 10**9)):
        for name, value in (("SHARD", shard), ("PART", part), ("MANY_EDGES", many)):
            monkeypatch.setattr(simhash, name, value)
        found = simhash.components(simhash.link_fingerprints(points, len(x))).collect()
        label = {int(v): k for k, v in enumerate(x.view(np.int64))}
        i, j = np.array([(label[r.node], label[r.root]) for r in found]).T
        got = simhash.roots(len(x), i, j)
        assert sorted(np.bincount(got)[np.unique(got)]) == expected and (got == root).all()


def brute_suffix(texts):
    """Of (id, bytes): bytes removed, the hash of the rest, and words in passages of 51 words that another document has."""
    count = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    owners = {}
    for d in set(texts):
        w = d[1].split()
        for i in range(len(w) - 50):
            owners.setdefault(tuple(w[i : i + 51]), set()).add(d)
    out = []
    for k, t in texts:
        gone, w = bytearray(len(t)), t.split()
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        inside = {i + j for i in range(len(w) - 50) if len(owners[tuple(w[i : i + 51])]) > 1 for j in range(51)}
        spans = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        out.append((str(k), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest(), len(inside)))
    return sorted(out)


def suffix_rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest(), r.n_passage_words) for r in suffix_dedup.remove_repeats(df).collect())


@pytest.mark.parametrize("rows", [1, 8000])
def test_suffix_dedup(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows)  # 1: every gram is split over buckets
    assert suffix_rows(docs) == brute_suffix([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_passages(spark, monkeypatch):
    """Short passages, a frequent phrase, a text over several blocks, and hot keys by broadcast."""
    monkeypatch.setattr("reportmill.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr("reportmill.llm.common.HOT_KEYS", 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    some = lambda n: [word() for _ in range(n)]
    shared, phrase, long_ = some(51), some(20), some(4000)
    rows = [(k, " ".join(some(rng.randint(1, 90)) + phrase + some(30))) for k in range(40)]
    rows += [(100 + k, " ".join(some(40) + shared[: 51 - k % 2] + some(40))) for k in range(8)]
    rows += [(200, " ".join(some(30) + shared[:50] + some(9) + shared[:50])), (201, " ".join(2 * some(60))), (202, " ".join(long_)), (203, "\n".join(some(7) + long_[1500:1700] + some(5)))]
    block = " ".join(some(75_000))  # over one block of bytes
    cut = len(block.encode()) - 1000
    assert cut > suffix_dedup.BLOCK + 2000
    rows += [(400, block), (401, "x " + block[suffix_dedup.BLOCK - 700 : suffix_dedup.BLOCK + 900]), (402, block[cut:])]
    rows += [(300, "é " * 500), (301, "é " * 260 + "x"), (302, "aa" * 900), (None, " ".join(shared)), (None, " ".join(shared)), (303, rows[0][1]), (304, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1)).withColumn("n", F.lit("x"))
    got = suffix_rows(df)
    assert got == brute_suffix([(k, (t or "").encode()) for k, t in rows])
    passages = {r[0]: r[5] for r in got}
    assert passages["100"] == 51 and passages["101"] == passages["200"] == passages["201"] == 0 and passages["203"] == 200


def test_sentencepiece(spark, docs):
    v = sentencepiece.vocabulary()
    texts = ["", " ", "a  b ▁ c\n日本 é\x00", "x" * 2000, None]
    for t, ids in zip(texts, sentencepiece.encode(texts, v)):
        assert (ids is None and t is None) or sentencepiece.decode(ids, v) == t
    word = " ththere"
    best = {0: 0.0}
    data = word.replace(" ", "\xff").encode("latin-1")
    score = {v.pieces[i]: v.scores[i] for i in v.normal}
    for i in range(len(data)):
        for j in range(i + 1, len(data) + 1):
            if i in best and data[i:j] in score:
                best[j] = max(best.get(j, -1e9), best[i] + score[data[i:j]])
    assert sum(v.scores[i] for i in sentencepiece.encode([word[1:]], v)[0]) == pytest.approx(best[len(data)])


@pytest.mark.parametrize("block", [700, 3000, 1 << 18])
def test_segments_tile_texts(monkeypatch, block):
    """Whatever the blocks, each window of a text is in one segment, with its anchor."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(n)) for n in (10, 60, 400, 2500)] + ["", None, "aa" * 2000]
    df = pd.concat(list(suffix_dedup._segments(iter([pd.DataFrame({"id": range(len(texts)), "text": texts})]))))
    for view in suffix_dedup.VIEWS:
        for k, text in enumerate(texts):
            mine = df[(df.id == k) & (df.gram & 1 == view.number)].sort_values("start")
            n = len(view.letters((text or "").encode())) - view.length + 1
            covered = [w for a, m in zip(mine.start, mine.windows) for w in range(a, a + m)]
            assert covered == list(range(max(0, n))) and (mine.lead >= mine.windows - 1).all() and (mine.lead <= view.length - view.gram).all()


def best_pieces(data, v):
    """Scores of all ways to cut bytes into pieces, by dynamic programming over characters; those without a piece cost the penalty."""
    starts = [i for i, c in enumerate(data) if c & 0xC0 != 0x80] + [len(data)]
    best = {0: 0.0}
    table = {v.pieces[i]: v.scores[i] for i in v.normal}
    for a, i in enumerate(starts[:-1]):
        options = [(j, table[data[i:j]]) for j in starts[a + 1 :] if data[i:j] in table]
        if all(j != starts[a + 1] for j, _ in options):
            options.append((starts[a + 1], v.unknown))
        for j, score in options:
            best[j] = max(best.get(j, -1e300), best[i] + score)
    return best[len(data)]


def cost(ids, data, v):
    """The score of an encoding, byte pieces counting once for each character."""
    total, at, byte = 0.0, 0, {int(i): b for b, i in enumerate(v.byte_ids)}
    while ids:
        if ids[0] in byte:
            n = next(k for k in range(1, 5) if at + k == len(data) or data[at + k] & 0xC0 != 0x80)
            assert [byte[i] for i in ids[:n]] == list(data[at : at + n])
            total, at, ids = total + v.unknown, at + n, ids[n:]
        else:
            total, at, ids = total + v.scores[ids[0]], at + len(v.pieces[ids[0]]), ids[1:]
    assert at == len(data)
    return total


@pytest.mark.parametrize("words", [True, False])
def test_unigram_viterbi(words):
    """Log scores at random, with ties, pieces that cross words or not, and characters that fall back to bytes: the best sum is found."""
    rng = random.Random(9)
    mark = bytes([sentencepiece.MARK])
    alphabet = ["a", "b", "c", "é", "日"]
    some = {mark} | {(rng.choice(["", "\xff"]) + "".join(rng.choices(alphabet, k=rng.randint(1, 5)))).encode().replace("ÿ".encode(), mark) for _ in range(150)}
    some |= set() if words else {b"a" + mark + b"b", b"c" + mark}
    normal = sorted(some)
    pieces = [b""] * 3 + [b""] * 256 + normal
    scores = np.array([0.0] * 259 + [-float(rng.randint(1, 6)) for _ in normal])
    v = sentencepiece.Vocabulary(pieces, scores, np.arange(3, 259), np.arange(259, len(pieces)))
    assert v.splits == words
    texts = ["".join(rng.choices([*alphabet, " ", "x", "\n"], k=rng.randint(1, 40))) for _ in range(300)] + ["ab" * 30_000, " ", "xx  é"]
    for text, ids in zip(texts, sentencepiece.encode(texts, v)):
        data = mark + text.encode().replace(b" ", mark)
        if len(text) < 100:
            assert cost([int(i) for i in ids], data, v) == pytest.approx(best_pieces(data, v))
        assert sentencepiece.decode(ids, v) == text
    assert [list(x) for x in sentencepiece.encode(texts, v)] == [list(x) for x in sentencepiece.encode(texts, v)]


def test_unigram_model_file(tmp_path):
    """A model file with log scores encodes as the public library does."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(12)
    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = "identity", True, False, True
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own = sorted({rng.choice(["", sentencepiece.MARKER]) + "".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(120)} | {sentencepiece.MARKER})
    for piece, score, kind in listed + [(x, -rng.uniform(2, 9), 1) for x in own]:
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    v, public = sentencepiece.load(str(path)), SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choices("abcdé zü", k=rng.randint(1, 50))) for _ in range(200)]
    assert [list(map(int, x)) for x in sentencepiece.encode(texts, v)] == public.encode(texts)


def test_sentencepiece_tables(spark):
    """Null, empty and very long texts, repeated rows, clashing columns and an empty table."""
    to_ids, to_text = sentencepiece.coders(sentencepiece.vocabulary(sentencepiece.model_path(spark)), spark)
    texts = [None, "", "same", "same", "a ▁ 日本\x00", "long text " * 50_000]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("other")).withColumn("decoded", F.lit(1))
    rows = df.select("*", to_ids("text").alias("found")).select("*", to_text("found").alias("back")).orderBy("doc_id").collect()
    assert [r.back for r in rows] == texts and rows[0].found is None and rows[1].found == [] and rows[2].found == rows[3].found and rows[0].ids == "other"
    assert df.limit(0).select(to_ids("text")).count() == 0


def katz_scores(texts, train, order):
    """log10 probabilities of texts (tuples of words) by Katz' definition, written out recursively; and P itself."""
    grams = [Counter() for _ in range(order + 1)]
    for words in train:
        for k in range(1, order + 1):
            padded = ["<s>"] * (k - 1) + words
            grams[k].update(tuple(padded[i : i + k]) for i in range(len(words)))
    n = sum(grams[1].values())
    d = [None] + [katz.discounts([sum(c == r for c in g.values()) for r in range(katz.K + 2)]) for g in grams[1:]]
    disc = lambda k, c: (d[k][c] if c <= katz.K else 1) * c
    seen = sum(disc(1, c) for c in grams[1].values())
    after = [{} for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            after[k].setdefault(g[:-1], []).append((g[-1], c))

    def whole(k, context):
        total, used = sum(c for _, c in after[k][context]), sum(disc(k, c) for _, c in after[k][context])
        return total + (used >= total - 1e-9), used

    def p(context, w):
        if not context:
            return disc(1, grams[1][w,]) / (n + (seen >= n)) if grams[1][w,] else 1 - seen / (n + (seen >= n))
        k = len(context) + 1
        if context not in after[k]:
            return p(context[1:], w)
        total, used = whole(k, context)
        if c := grams[k][(*context, w)]:
            return disc(k, c) / total
        return (1 - used / total) / (1 - sum(p(context[1:], x) for x, _ in after[k][context])) * p(context[1:], w)

    from functools import lru_cache

    p = lru_cache(None)(p)
    scores = []
    for words in texts:
        padded = ["<s>"] * (order - 1) + words
        scores.append(sum(np.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(words)))
    return scores, p, grams


@pytest.mark.parametrize("order,split", [(1, False), (2, False), (3, False), (3, True), (4, True)])
def test_katz(spark, docs, monkeypatch, tmp_path, order, split):
    """Scores by definition, also where contexts are split over buckets, and again from the stored tables."""
    if split:
        monkeypatch.setattr(katz, "BUCKET", 40)
        monkeypatch.setattr(katz, "HOT_SHARE", 1e-3)
    rows = katz.score_corpus(docs, F.col("doc_id") % 7 == 2, order=order, store=str(tmp_path / "model")).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.collect()]
    train = [w for k, w in texts if k is None or k % 7 != 2]
    scores, p, grams = katz_scores([w for _, w in texts], train, order)
    contexts = [()] + [g[:-1] for g in list(grams[order])[:20] if order > 1]
    assert all(abs(sum(p(c, w) for (w,) in grams[1]) + p(c, "unseen") - 1) < 1e-9 for c in contexts)
    expected = sorted((str(k), len(w), round(s, 6)) for (k, w), s in zip(texts, scores))
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in rows) == expected
    again = katz.score_stored(docs, str(tmp_path / "model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), r.n_known, round(r.base_score, 6), r.train_tokens) for r in again) == sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), r.n_known, round(r.base_score, 6), r.train_tokens) for r in rows)
    levels = {r.level for r in spark.read.parquet(str(tmp_path / "model" / "tables")).select("level").distinct().collect()}
    assert levels == set(range(1, order + 1))
    if split:
        known = spark.read.schema(katz.KNOWN).parquet(str(tmp_path / "model" / "known")).first()
        table = spark.read.schema(katz.TABLES).parquet(str(tmp_path / "model" / "tables")).filter("level = 2").collect()
        places = Counter(v for r in table for v in set(katz.unpack(bytes(r.v), True).tolist()))
        assert all(known.split) and known.buckets > 10 and max(places.values()) > 1  # a context in several buckets


def test_katz_corners(spark, docs, monkeypatch):
    assert katz.score_corpus(docs.limit(0), F.lit(False)).count() == 0
    rows = katz.score_corpus(docs.withColumn("chunk", F.lit(1)), F.lit(True), order=3).collect()  # nothing to learn from
    assert len(rows) == docs.count() and all(r.score == r.n_known == r.train_tokens == 0 for r in rows)
    long_ = spark.createDataFrame([(1, "a b " * 300_000), (2, None), (None, "b a"), (None, "b a")], "doc_id long, text string")
    rows = katz.score_corpus(long_, F.lit(False), order=3).collect()
    assert sorted((r.n_tokens, r.doc_id or 0) for r in rows) == [(1, 2), (3, 0), (3, 0), (600_001, 1)]


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["good", "plain", "words", "here"], k=30) + (["vilest"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels, F.col("doc_id") % 3 != 1).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in scored)
    assert toxicity.score_toxicity(docs.limit(3), labels.limit(0), F.lit(True)).count() == 3


def test_toxicity_corners(spark):
    """Null and empty texts, null labels, several labels of an id, repeated rows, one label only, clashing columns, a very long text."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["good", "plain", "words", "here"], k=30) + (["vilest"] if k % 4 == 0 else []))) for k in range(200)]
    rows += [(300, None), (301, ""), (302, "vilest " * 200_000), (303, rows[4][1]), (303, rows[4][1]), (None, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(7)).withColumn("features", F.lit("f"))
    marks = [(k, int(k % 4 == 0)) for k in range(200)] + [(4, 1), (301, None), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.label == 7 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[302] > 0.7 and by[300] == by[301] and by[303] == by[4] > 0.7 > by[5] and len({r.score for r in got if r.doc_id == 303}) == 1
    assert sorted(map(str, got)) == sorted(map(str, toxicity.score_toxicity(docs, labels, F.lit(True)).collect()))
    one = toxicity.score_toxicity(docs, labels.filter("toxic = 1"), F.lit(True)).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_simhash_corners(spark):
    """An empty table, nulls, repeated rows, a hot fingerprint, clashing columns, a very long text."""
    rows = [(k, None if k % 2 else " ") for k in range(2000)] + [(5000, "one two three four five"), (5000, "one two three four five"), (None, "one two three four five"), (None, "alone " * 9), (6000, "long words " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_dedup(docs.withColumn("fp", F.lit(1)).withColumn("n", F.lit("n")).withColumn("first", F.lit(0))).collect()
    assert len(got) == len(rows) and all(r.component_id == 0 and r.fp == 0 for r in got if r.doc_id is not None and r.doc_id < 2000)
    assert sorted(str(r.component_id) for r in got if r.doc_id is None or r.doc_id >= 5000) == ["5000", "5000", "5000", "6000", "None"]
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://b.a/x y", "same"), (1, "http://c.a/", "same\r\n\r\nnot"), (2, None, "same"), (7, "http://b.a/", None), (9, "u", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.capture_histories(pages).collect()}
    assert rows[3].record_type == "revisit" and rows[3].refers_to == 2 and rows[9].refers_to == 7 and rows[1].payload_bytes == 11
    assert rows[3].payload_digest == warc.base32_digest(b"same")
    runs = [iter(sorted(random.Random(k).choices(range(50), k=k))) for k in range(7)]
    every = sorted(x for k in range(7) for x in random.Random(k).choices(range(50), k=k))
    assert list(warc.LoserTree(runs)) == every


def test_warc_histories(spark, monkeypatch):
    """Many archives of all classes of size in many ranges: a global order, whole payloads, null ids, repeated rows, hot payloads."""
    for name, value in (("RECORDS_PER_FILE", 7), ("RANGE_ROWS", 40), ("CLASSES", (300, 2000)), ("ARCHIVE_BYTES", 3000)):
        monkeypatch.setattr(warc, name, value)
    monkeypatch.setattr("reportmill.llm.common.HOT_ROWS", 5)
    rng = random.Random(4)
    rows = [(k, f"http://h{rng.randrange(9)}.example/{rng.randrange(20)}", "é\r\n\r\n" * rng.choice([0, 1, 9, 90, 500]) + (str(k) if k % 3 else "")) for k in range(300)]
    rows += [(None, "http://h1.example/0", "x"), (None, None, None), (5, rows[5][1], rows[5][2]), (700, "http://h1.example/%zz[", "big" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("id", F.lit(1)).withColumn("first", F.lit(2)).withColumn("value", F.lit("v")).repartition(9)
    got = sorted(warc.capture_histories(pages).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and len({r.file for r in got}) > 40
    keys = [(r.url_key, r.ts, r.page_id is None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    payload = {}
    for k, _, html in rows:
        payload.setdefault((html or "").encode(), []).append(k)
    least = {html: min((k for k in ks if k is not None), default=None) for html, ks in payload.items()}
    expected = sorted((str(k), len((h or "").encode()), warc.base32_digest((h or "").encode()), "revisit" if k is not None and least[(h or "").encode()] != k else "response", str(least[(h or "").encode()] if k is not None and least[(h or "").encode()] != k else None)) for k, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expected
    histories = {}
    for r in sorted(warc.history_number(warc.capture_histories(pages)).collect(), key=lambda r: r.position):
        histories.setdefault(r.url_key, []).append(r.capture)
    assert all(h == list(range(1, len(h) + 1)) for h in histories.values()) and max(map(len, histories.values())) > 2
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_warc_min_bytes_and_damage(spark):
    pages = spark.createDataFrame([(k, "http://a.example/", "ab" if k < 3 else "abcdef") for k in range(6)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.capture_histories(pages, min_bytes=4).collect()}
    assert all(rows[k].record_type == "response" for k in (0, 1, 2, 3)) and rows[4].refers_to == rows[5].refers_to == 3
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 24\r\n\r\nA\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record * 2)  # of several members
    assert [(at, size) for _, _, at, size in warc.parse_records(whole)] == [(k * len(record), len(record)) for k in range(3)]
    for broken in (gzip.compress(record[:-6]), gzip.compress(b"x" + record), gzip.compress(record + b"\r\n")):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


def test_toxicity_fit_by_definition(spark):
    """The weights of the fit are as good as those of plain gradient descent over dictionaries of features, and give the same scores."""
    rng = random.Random(31)
    mild, harsh = [f"calm{k}" for k in range(12)], [f"vile{k}" for k in range(6)]
    rows = [(k, " ".join(rng.choices(mild, k=5) + rng.choices(harsh if k % 3 == 0 else mild, k=2)), int(k % 3 == 0)) for k in range(45)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    weight, intercept = toxicity.train(docs, labels, F.lit(True))
    features = [np.unique(np.concatenate([h for _, h in toxicity.present([r[1]])])) for r in rows]
    y = np.array([r[2] for r in rows])
    n = {c: int((y == c).sum()) for c in (0, 1)}
    counts = {c: Counter(f for x, z in zip(features, y, strict=True) if z == c for f in x.tolist()) for c in (0, 1)}
    extra = {c: toxicity.SMOOTH * n[c] / len(y) for c in (0, 1)}
    known = sorted(set(counts[0]) | set(counts[1]))
    scale = np.array([np.log((counts[1][f] + extra[1]) / (n[1] + extra[1])) - np.log((counts[0][f] + extra[0]) / (n[0] + extra[0])) for f in known])
    dense = np.array([np.isin(known, x) for x in features]) * scale
    share, penalty = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]), toxicity.PENALTY / len(y)

    def objective(w, b):
        margin = dense @ w + b
        return float((share * (np.logaddexp(0, margin) - y * margin)).sum() + penalty / 2 * (w @ w))

    w, b, rate = np.zeros(len(known)), 0.0, 1.0 / (0.25 * np.linalg.norm(dense * np.sqrt(share)[:, None], 2) ** 2 + penalty + 0.25)
    for _ in range(20_000):
        error = share * (1 / (1 + np.exp(-(dense @ w + b))) - y)
        w, b = w - rate * (dense.T @ error + penalty * w), b - rate * error.sum()
    mine = np.divide(weight[known], scale, out=np.zeros(len(known)), where=scale != 0)
    assert objective(mine.astype(float), intercept) <= objective(w, b) * 1.01 + 1e-6
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    want = 1 / (1 + np.exp(-(dense @ w + b)))
    assert max(abs(scores[k] - want[k]) for k in range(len(rows))) < 0.05
