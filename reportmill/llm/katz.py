"""Language-model scoring: Katz backoff over n-grams of any order.

P(w | context) is the Good-Turing discounted relative count where the n-gram was seen, else alpha(context) times P(w | the context without its
first word), and so on down to single words: P(w) is the discounted unigram share where the word was seen, else the mass that discounting
left (one class for all unseen words). Contexts that were not seen are left out: their P is that of the shorter one. Backoff weights are
exact: alpha(context) = (1 - seen mass) / (1 - mass of the words seen after it under the shorter context), so every context's
distribution sums to 1 over the vocabulary and the unseen class. A text starts in a context of its own.

Tokens are never joined one by one. Documents are packed into chunks (about ``CHUNK`` tokens) with a local dictionary. Level by level, from
words up, chunks send their distinct n-grams to hash buckets as compressed columns; a bucket adds up the counts, keeps its part of the
level's table, and answers each chunk from it, in the chunk's own order: counts, numbers (by which the next level names its contexts) and
the sums of the contexts. Each token's probability is then evaluated recursively over the levels. Contexts with very many followers are
split over several buckets by their last word and their sums are added up again, so no context need fit into one task; there is a bounded
number of such contexts.

The tables are written to the shared folder, partitioned by kind; with ``store`` they are kept as a model, partitioned by level and sorted by
bucket, from which ``score_stored`` scores other texts: there the buckets answer from the stored tables and nothing is learnt.

Defined results: null text is an empty text: one end token; null ids are scored like others and take part as ``fold`` says (null: training);
repeated rows count and are scored each; without training tokens every token is unseen and has probability 1; extra columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm.common import materialize

CHUNK = 1 << 20
#: Entries of a bucket, about.
BUCKET = 1 << 20
#: Counts up to this are discounted.
K = 5
#: Contexts split over buckets are those with at least this share of all tokens (and BUCKET tokens), so at most 1 / share of them in a level.
HOT_SHARE = 1e-4
START, END, FIRST = 0, 1, 2


def pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """Integers as byte planes, compressed; sorted ones as differences."""
    x = np.ascontiguousarray(np.diff(x, prepend=np.int64(0)) if sorted_ else x, np.int64)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 3) if len(x) else b""


def unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)
    return np.cumsum(x) if sorted_ else x


def discounts(n: list[int]) -> np.ndarray:
    """Katz' ratios for counts 0 to K from the counts of counts n[1..K+1]; absolute discounting where Good-Turing gives none."""
    d = np.ones(K + 1)
    if not n[1]:
        return d
    common = (K + 1) * n[K + 1] / n[1]
    flat = n[1] / (n[1] + 2 * n[2])
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and n[r + 1] and common < 1 else 0
        d[r] = good if 0 < good < 1 else (r - flat) / r
    return np.where(d > 0, d, 0.5)


class Unigrams:
    """Probabilities by count. n: counts of counts up to K + 1; tokens and types: totals; big: tokens of types counted over K times."""

    def __init__(self, n: list[int], tokens: int, types: int):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        rest = tokens - sum(r * n[r] for r in range(1, K + 1))
        seen = sum(self.d[r] * r * n[r] for r in range(1, K + 1)) + rest
        self.whole = tokens + (seen >= tokens)  # without discounts one more token stands for the unseen
        self.unseen = 1 - seen / self.whole

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K) * (count <= K)] * count / self.whole, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))


CHUNKS = "chunk long, ids array<long>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary, n_words long, n_train long"


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    local: dict[bytes, int] = {}
    ids: list[int | None] = []
    held: list[bool] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> pd.DataFrame:
        tokens = np.concatenate(parts)
        train = np.repeat(~np.array(held), lengths)
        row = [number, list(ids), list(held), pack(np.array(lengths)), pack(tokens), zstandard.compress(b" ".join(local), 3), pack(np.bincount(tokens[train], minlength=len(local))), len(local), held.count(False)]
        return pd.DataFrame([row], columns=[x.split()[0] for x in CHUNKS.split(", ")])

    total = 0
    for df in batches:
        for id_, text, out in zip(df.id, df.text, df.held, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
            parts.append(np.array([local.setdefault(w, len(local)) for w in words], np.int64))
            ids.append(None if pd.isna(id_) else int(id_))
            held.append(bool(out))
            lengths.append(len(words))
            total += len(words) + 1
            if total >= CHUNK:
                yield flush()
                number += 1
                local, ids, held, lengths, parts, total = {}, [], [], [], [], 0
    if ids:
        yield flush()


def _hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _count_words(n_buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for chunk, words, counts in zip(df.chunk, df.words, df.counts, strict=True):
                words = zstandard.decompress(words).split(b" ") if words and zstandard.decompress(words) else []
                counts, h = unpack(counts), _hash(words) % np.uint64(n_buckets)
                order = np.argsort(h, kind="stable")
                cuts = np.searchsorted(h[order], np.arange(n_buckets + 1, dtype=np.uint64))
                rows = [(b, chunk, zstandard.compress(b" ".join([words[i] for i in order[cuts[b] : cuts[b + 1]]]), 3), pack(counts[order[cuts[b] : cuts[b + 1]]])) for b in np.flatnonzero(np.diff(cuts))]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "counts"])

    def answer(df: pd.DataFrame) -> pd.DataFrame:
        """A row for the table, then one for each chunk: counts and numbers of its words, in its order. A stored table comes as chunk -1."""
        total: dict[bytes, int] = {}
        asked = []
        for chunk, words, counts in sorted(zip(df.chunk, df.words, df.counts, strict=True)):
            words = zstandard.decompress(words)
            words = words.split(b" ") if words else []
            for w, c in zip(words, unpack(counts).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
            if chunk >= 0:
                asked.append((chunk, words))
        bucket = int(df.bucket.iloc[0])
        known = sorted((w for w, c in total.items() if c), key=lambda w: (-total[w], w))
        number = {w: FIRST + k * n_buckets + bucket for k, w in enumerate(known)}
        rows = [("table", bucket, -1, zstandard.compress(b" ".join(known), 3), pack(np.array([total[w] for w in known], np.int64)), b"")]
        rows += [("reply", bucket, chunk, b"", pack(np.array([total[w] for w in words], np.int64)), pack(np.array([number.get(w, -1) for w in words], np.int64))) for chunk, words in asked]
        return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "words", "counts", "numbers"])

    return send, answer


@dataclass
class Model:
    """What is known of the whole corpus, level by level; bounded, whatever the corpus.

    size: entries of a bucket; hot: followers from which a context is split; n: counts of counts 0 to K + 1 of each level; split: the sums of contexts that several buckets share, for each level from 2 on."""

    tokens: int
    types: int
    train_docs: int
    word_buckets: int
    buckets: int
    size: int
    hot: float
    n: list[list[int]] = field(default_factory=list)
    split: list[dict[int, np.ndarray]] = field(default_factory=list)

    @property
    def uni(self) -> Unigrams:
        return Unigrams(self.n[0], self.tokens, self.types)

    def d(self, level: int) -> np.ndarray:
        return discounts(self.n[level - 1])


@dataclass
class Level:
    """Of each token: the training count of the n-gram that ends there, its number (-1: not seen), what its context's counts are
    relative to (0: the context was not seen) and the context's backoff weight. Level 1 has the first two only."""

    count: np.ndarray
    number: np.ndarray
    whole: np.ndarray
    alpha: np.ndarray


def probability(levels: list[Level], model: Model) -> np.ndarray:
    """P of each token under its longest context: discounted where the n-gram was seen, else the weight times P under the shorter one."""
    *shorter, last = levels
    if not shorter:
        return model.uni.p(last.count)
    d, count = model.d(len(levels)), last.count
    seen = d[np.minimum(count, K) * (count <= K)] * count / np.maximum(last.whole, 1)
    return np.where(count > 0, seen, last.alpha * probability(shorter, model))


class Asks:
    """The distinct n-grams of a chunk after seen contexts, in order of (context, word), and the tokens that they are of."""

    def __init__(self, chunk: Chunk, model: Model):
        last, first = chunk.levels[-1], chunk.first
        # The context is the n-gram before, one level down; a text's start is a context of its own in every level.
        v, vc = np.concatenate([[0], last.number[:-1]]), np.concatenate([[0], last.count[:-1]])
        v[first], vc[first] = (START if model.train_docs else -1), model.train_docs
        # An unknown last word counts as START, which follows nothing: it asks for the context's sums only.
        self.at, w = np.flatnonzero(v >= 0), np.where(chunk.word < 0, START, chunk.word)
        order = np.lexsort((w[self.at], v[self.at]))
        at = self.at[order]
        new = np.concatenate([[True], (v[at][1:] != v[at][:-1]) | (w[at][1:] != w[at][:-1])])[: len(at)]
        which = np.cumsum(new) - 1
        self.which = np.empty(len(at), np.int64)
        self.which[order] = which
        self.v, self.w, self.vc, self.shorter, self.shorter_whole = v[at][new], w[at][new], vc[at][new], last.count[at][new], last.whole[at][new]
        n = int(new.sum())
        self.trained = np.bincount(which[~chunk.held[chunk.doc[at]]], minlength=n) if n else np.zeros(0, np.int64)
        part = np.where(self.vc >= model.hot, self.w % np.maximum(1, self.vc // model.size + 1), 0).astype(np.uint64)
        self.bucket = ((self.v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) % np.uint64(model.buckets)
        self.order = np.argsort(self.bucket, kind="stable")
        self.cuts = np.searchsorted(self.bucket[self.order], np.arange(model.buckets + 1, dtype=np.uint64))

    def answered(self, told: pd.DataFrame, tokens: int, level: int, model: Model) -> Level:
        told = told.sort_values("bucket")
        count, number, vs = np.zeros(len(self.v), np.int64), np.full(len(self.v), -1, np.int64), np.unique(self.v)
        sums = np.zeros((K + 2, len(vs)))
        if len(self.v):
            count[self.order] = np.concatenate([unpack(x) for x in told.counts])
            if told.numbers.map(len).any():
                number[self.order] = np.concatenate([unpack(x) for x in told.numbers])
            for k, s, p in zip(told.bucket.astype(int), told.seen, told.mass, strict=True):
                mine = np.searchsorted(vs, np.unique(self.v[self.order[self.cuts[k] : self.cuts[k + 1]]]))
                sums[: K + 1, mine], sums[K + 1, mine] = unpack(s).reshape(K + 1, -1), np.frombuffer(zstandard.decompress(p))
            # A context that is not split is in one bucket; a split one has its sums in the model.
            split = model.split[level - 2]
            for x in np.flatnonzero(np.isin(vs, np.fromiter(split, np.int64, len(split)))):
                sums[:, x] = split[int(vs[x])]
        whole, used = relative(sums[: K + 1], model.d(level))
        alpha = (1 - used / np.maximum(whole, 1)) / (1 - sums[K + 1])
        out = Level(np.zeros(tokens, np.int64), np.full(tokens, -1, np.int64), np.zeros(tokens, np.int64), np.ones(tokens))
        ask, context = self.which, np.searchsorted(vs, self.v[self.which])
        out.count[self.at], out.number[self.at] = count[ask], number[ask]
        if len(vs):
            out.whole[self.at], out.alpha[self.at] = whole[context], alpha[context]
        return out


def relative(seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts after a context are relative to, and what discounts leave of them. seen: n-grams counted 1 to K times, and the tokens of the others."""
    followers, used = np.arange(1, K + 1) @ seen[:K] + seen[K], (d[1:] * np.arange(1, K + 1)) @ seen[:K] + seen[K]
    return (followers + (used >= followers - 1e-9)).astype(np.int64), used  # without discounts one more token stands for the unseen


class Chunk:
    """A chunk's tokens and their levels, from its row and the buckets' replies."""

    def __init__(self, row: pd.Series, replies: list[pd.DataFrame], model: Model):
        self.ids, self.held, self.lengths = list(row.ids), np.array(row.held, bool), unpack(row.lengths)
        words = zstandard.decompress(row.dictionary)
        h = _hash(words.split(b" ")) % np.uint64(model.word_buckets) if words else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")  # as sent: by bucket, then in the chunk's order
        told = replies[0].sort_values("bucket")
        count, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if len(h):
            count[order] = np.concatenate([unpack(x) for x in told.counts])
            number[order] = np.concatenate([unpack(x) for x in told.numbers])
        count, number = np.append(count, model.train_docs), np.append(number, END if model.train_docs else -1)
        tokens, ends = unpack(row.tokens), np.cumsum(self.lengths)
        tokens = np.insert(tokens, ends, len(h))  # each document's end
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths + 1)
        self.first = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]])
        self.word = number[tokens]
        self.levels = [Level(count[tokens], self.word, np.zeros(len(tokens), np.int64), np.ones(len(tokens)))]
        for k, told in enumerate(replies[1:], 2):
            self.levels.append(Asks(self, model).answered(told, len(tokens), k, model))


def _by_chunk(chunks: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables that have ``chunk``, as one table of the same columns."""
    columns = {f.name: f.dataType for x in (chunks, *others) for f in x.schema}
    tables = [x.select(F.lit(k).alias("from"), *[(F.col(c) if c in x.columns else F.lit(None).cast(t).alias(c)) for c, t in columns.items()]) for k, x in enumerate((chunks, *others))]
    return reduce(DataFrame.unionAll, tables)


PAIRS = "bucket int, chunk long, v binary, w binary, trained binary, shorter binary, shorter_whole binary, hot binary"
#: seen: for each context, its n-grams counted 1 to K times, the tokens of the others; mass: of all, under the shorter context.
ANSWERS = "kind string, bucket int, chunk long, v binary, w binary, counts binary, numbers binary, seen binary, mass binary, n array<long>"


def _load(df: pd.DataFrame, levels: int, model: Model) -> Chunk:
    return Chunk(df[df["from"] == 0].iloc[0], [df[df["from"] == k] for k in range(1, levels + 1)], model)


def _send(levels: int, model: Model):
    def send(df: pd.DataFrame) -> pd.DataFrame:
        asks, rows = Asks(_load(df, levels, model), model), []
        chunk = int(df.chunk.iloc[0])
        for k in np.flatnonzero(np.diff(asks.cuts)):
            at = asks.order[asks.cuts[k] : asks.cuts[k + 1]]
            rows.append((k, chunk, pack(asks.v[at], True), pack(asks.w[at]), pack(asks.trained[at]), pack(asks.shorter[at]), pack(asks.shorter_whole[at]), pack((asks.vc[at] >= model.hot).astype(np.int64))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PAIRS.split(", ")])

    return send


def _answer(level: int, last: bool, model: Model):
    """A bucket of a level: a row for the table, its contexts' sums if other buckets have the same contexts, and a reply to each chunk.

    A stored table comes as a row of chunk -1, with its counts as ``trained`` and its contexts' sums as ``seen`` and ``mass``."""

    def answer(df: pd.DataFrame) -> pd.DataFrame:
        df, bucket = df.sort_values("chunk"), int(df.bucket.iloc[0])
        held = [tuple(unpack(getattr(r, x), x == "v") for x in ("v", "w", "trained")) for r in df.itertuples()]
        v, w, trained = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((w, v))
        new = np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])])[: len(order)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        count = np.bincount(which, trained, int(new.sum())).astype(np.int64)
        at, known = order[new], count > 0
        number = np.where(known, np.cumsum(known) * model.buckets + bucket, -1)
        cv, ck = v[at][known], count[known]
        contexts, context = np.unique(cv, return_inverse=True)
        m, rows = len(contexts), []
        stored = df.chunk.iloc[0] < 0
        if stored:
            seen, mass = unpack(df.seen.iloc[0]).reshape(K + 1, -1), np.frombuffer(df.mass.iloc[0])
        else:
            shorter, whole = (np.concatenate([unpack(x) for x in df[c]])[at][known] for c in ("shorter", "shorter_whole"))
            cp = model.uni.p(shorter) if level == 2 else model.d(level - 1)[np.minimum(shorter, K) * (shorter <= K)] * shorter / np.maximum(whole, 1)
            seen = np.stack([np.bincount(context[ck == r], minlength=m) for r in range(1, K + 1)] + [np.bincount(context, ck * (ck > K), m).astype(np.int64)]) if m else np.zeros((K + 1, 0), np.int64)
            mass = np.bincount(context, cp, m) if m else np.zeros(0)
            rows.append(("table", bucket, -1, pack(cv, True), pack(w[at][known]), pack(ck), b"", pack(np.ascontiguousarray(seen).reshape(-1)), mass.tobytes(), np.bincount(np.minimum(ck, K + 2), minlength=K + 3).tolist()))
            heated = np.isin(contexts, v[np.concatenate([unpack(x) for x in df.hot]) > 0])
            if heated.any():
                rows.append(("hot", bucket, -1, pack(contexts[heated], True), b"", b"", b"", pack(np.ascontiguousarray(seen[:, heated]).reshape(-1)), mass[heated].tobytes(), []))
        start = 0
        for chunk, (own, *_) in zip(df.chunk, held, strict=True):
            mine = which[start : start + len(own)]
            start += len(own)
            if chunk < 0:
                continue
            asked = np.unique(own)
            place = np.minimum(np.searchsorted(contexts, asked), max(m - 1, 0))
            has = contexts[place] == asked if m else np.zeros(len(asked), bool)
            told, sums = np.zeros((K + 1, len(asked)), np.int64), np.zeros(len(asked))
            told[:, has], sums[has] = seen[:, place[has]], mass[place[has]]
            rows.append(("reply", bucket, chunk, b"", b"", pack(count[mine]), b"" if last else pack(number[mine]), pack(told.reshape(-1)), zstandard.compress(sums.tobytes(), 3), []))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return answer


def _split_sums(answers: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the contexts that several buckets share: at most 1 / HOT_SHARE of them, each once for each of its buckets."""
    split: dict[int, np.ndarray] = {}
    for r in answers.filter("kind = 'hot'").select("v", "seen", "mass").toLocalIterator():
        vs = unpack(bytes(r.v), True)
        for x, s, p in zip(vs.tolist(), unpack(bytes(r.seen)).reshape(K + 1, -1).T, np.frombuffer(bytes(r.mass)), strict=True):
            split[x] = split.get(x, np.zeros(K + 2)) + np.append(s, p)
    return split


def _words(chunks: DataFrame, n_buckets: int, stored: DataFrame | None) -> DataFrame:
    send, answer = _count_words(n_buckets)
    sent = chunks.select("chunk", "words", "counts").mapInPandas(send, "bucket int, chunk long, words binary, counts binary")
    if stored is not None:
        sent = sent.unionByName(stored.filter("level = 1").select("bucket", "chunk", "words", "counts"))
    columns = "kind string, bucket int, chunk long, words binary, counts binary, numbers binary"
    return materialize(sent.groupBy("bucket").applyInPandas(answer, columns), "lm-words", ["kind"])


def _totals(table: DataFrame, train_docs: int) -> tuple[list[int], int, int]:
    """Counts of counts, tokens and types of single words, ends included."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for counts in df.counts:
                c = unpack(counts)
                yield pd.DataFrame({"n": [np.bincount(np.minimum(c, K + 2), minlength=K + 3).tolist()], "tokens": [int(c.sum())], "types": [len(c)]})

    stats = table.select("counts").mapInPandas(summed, "n array<long>, tokens long, types long")
    *n, tokens, types = stats.agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(K + 2)], F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    if 0 < train_docs <= K + 1:
        n[train_docs] += 1
    return n, tokens + train_docs, types + bool(train_docs)


def _chunked(docs: DataFrame, held_out: Column, text_col: str, id_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return materialize(source.mapInPandas(_chunks, CHUNKS), "lm-chunks")


def score_corpus(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", order: int = 2, store: str | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model learns from the others.

    order: words of the longest n-grams. store: a folder to keep the model's tables in."""
    chunks = _chunked(docs, held_out, text_col, id_col)
    entries, train_docs = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    word_buckets = max(1, -(-entries // BUCKET) * 2)
    words = _words(chunks, word_buckets, None)
    n, tokens, types = _totals(words.filter("kind = 'table'"), train_docs)
    model = Model(tokens, types, train_docs, word_buckets, max(1, -(-tokens // BUCKET)), BUCKET, max(BUCKET, HOT_SHARE * tokens), [n])
    return _scored(chunks, words, model, order, None, store, id_col)


def _scored(chunks: DataFrame, words: DataFrame, model: Model, order: int, stored: DataFrame | None, store: str | None, id_col: str) -> DataFrame:
    if store:
        _keep(words.filter("kind = 'table'").select("bucket", "words", "counts"), 1, store)
    asked = chunks.select("chunk", "ids", "held", "lengths", "tokens", F.col("words").alias("dictionary"))
    replies = [words.filter("kind = 'reply'").select("chunk", "bucket", "counts", "numbers")]
    for level in range(2, order + 1):
        pairs = _by_chunk(asked, *replies).groupBy("chunk").applyInPandas(_send(level - 1, model), PAIRS)
        if stored is not None:
            mine = stored.filter(F.col("level") == level).select("bucket", "chunk", "v", "w", F.col("counts").alias("trained"), "seen", "mass")
            pairs = pairs.unionByName(mine, allowMissingColumns=True)
        answers = materialize(pairs.groupBy("bucket").applyInPandas(_answer(level, level == order, model), ANSWERS), f"lm-{level}-grams", ["kind"])
        if stored is None:
            model.n.append(list(answers.filter("kind = 'table'").agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(K + 2)]).first()))
            model.split.append(_split_sums(answers))
        if store:
            _keep(answers.filter("kind = 'table'").select("bucket", "v", "w", "counts", "seen", "mass"), level, store)
        replies.append(answers.filter("kind = 'reply'").select("chunk", "bucket", "counts", "numbers", "seen", "mass"))
    if store:
        _describe(model, order, chunks.sparkSession, store)

    def score(df: pd.DataFrame) -> pd.DataFrame:
        c = _load(df, order, model)
        p, m, count = probability(c.levels, model), len(c.ids), c.levels[0].count
        return pd.DataFrame({
            "id": pd.array(c.ids, "Int64"), "held_out": c.held, "n_tokens": c.lengths + 1, "n_known": np.bincount(c.doc[count > 0], minlength=m),
            "base_score": np.bincount(c.doc, model.uni.base(count), m), "score": np.bincount(c.doc, np.log10(p), m),
        })

    scored = _by_chunk(asked, *replies).groupBy("chunk").applyInPandas(score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


#: A stored model: tables by level, and what is known of the whole corpus.
TABLES = "bucket int, words binary, v binary, w binary, counts binary, seen binary, mass binary, level int"
KNOWN = "tokens long, types long, train_docs long, word_buckets long, buckets long, size long, hot double, n array<array<long>>, split array<map<long,array<double>>>"


def _keep(table: DataFrame, level: int, store: str) -> None:
    columns = [x.split() for x in TABLES.split(", ")]
    full = table.withColumn("level", F.lit(level)).select(*[F.col(c) if c in table.columns or c == "level" else F.lit(None).cast(t).alias(c) for c, t in columns])
    full.sortWithinPartitions("bucket").write.mode("append").partitionBy("level").parquet(f"{store.rstrip('/')}/tables")


def _describe(model: Model, order: int, spark: SparkSession, store: str) -> None:
    split = [{k: x.tolist() for k, x in s.items()} for s in model.split]
    row = (model.tokens, model.types, model.train_docs, model.word_buckets, model.buckets, model.size, float(model.hot), [list(map(int, x)) for x in model.n], split)
    spark.createDataFrame([row], KNOWN).coalesce(1).write.parquet(f"{store.rstrip('/')}/known")


def score_stored(docs: DataFrame, store: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores of texts by a stored model, which learns nothing from them. Columns as those of ``score_corpus``, all held out."""
    spark = docs.sparkSession
    known = spark.read.schema(KNOWN).parquet(f"{store.rstrip('/')}/known").first()
    model = Model(*known[:7], [list(x) for x in known.n], [{k: np.array(x) for k, x in s.items()} for s in known.split])
    stored = spark.read.schema(TABLES).parquet(f"{store.rstrip('/')}/tables").withColumn("chunk", F.lit(-1).cast("long"))
    chunks = _chunked(docs, F.lit(True), text_col, id_col)
    return _scored(chunks, _words(chunks, model.word_buckets, stored), model, len(model.n), stored, None, id_col)
