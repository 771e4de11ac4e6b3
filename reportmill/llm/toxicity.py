"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams that occur in it (presence, so that length does not
dilute them). Each feature is scaled by the log ratio of its smoothed document counts under the two labels,
and a logistic regression with an L2 penalty is fitted on the scaled features. All features take part; their number is bounded
by the width of the hash only.

Training reads at most about ``MAX_TRAIN`` labelled rows (taken by hash, so reruns agree). Their features stay on the executors:
the driver gets a vector of counts of each task, and then, for each step of the fit (L-BFGS), a gradient of each. The score reads whole texts.

Defined results: null text is empty; texts without features that were met in training get the model's intercept; rows
with null labels are not trained on; of several labels of an id each is a row; with one label only, or none, every
score is that label's smoothed rate; repeated rows score alike; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import discard, materialize, small_batches

#: Bound of the labelled sample; buckets of the hash, as a power of 2; tasks of the sample.
MAX_TRAIN, BITS, TASKS = 20_000, 19, 8
#: Documents that smooth the counts: ratios of features in far fewer are near 0. Weight of the L2 penalty.
SMOOTH, PENALTY = 300, 0.1
ORDERS = (4, 5, 6)
THRESHOLD = 0.7
#: Characters of a text that are hashed at once; training rows of a block, and features from which on it takes no more.
CHUNK, ROWS, FEATURES = 1 << 20, 64, 500_000
#: Steps of the fit at most, steps that the curvature is taken from, and the relative gain that ends it.
STEPS, MEMORY, GAIN = 40, 6, 1e-4

#: ASCII letters are lower-cased; punctuation, white space and control characters become spaces; digits and bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def _hashes(data: np.ndarray, upto: int) -> np.ndarray:
    """Buckets of all n-grams that start before ``upto``."""
    x, out = data.astype(np.uint32), []
    h = x * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n - 1 :] * np.uint32(0xC2B2AE35) if len(x) >= n else h[:0]
        if n in ORDERS:
            out.append(((h[:upto] ^ (h[:upto] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + np.uint32(n)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def present(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """The number of a text and its distinct features; a long text gives several arrays with different features."""
    place, seen = np.zeros(1 << BITS, np.int32), np.full(1 << BITS, -1, np.int32)
    for k, text in enumerate(texts):
        data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)
        for at in range(0, len(data), CHUNK):
            h = _hashes(data[at : at + CHUNK + max(ORDERS) - 1], CHUNK)
            order = np.arange(len(h), dtype=np.int32)
            place[h] = order
            h = h[place[h] == order]  # each once
            if len(data) > CHUNK:
                h = h[seen[h] != k]
                seen[h] = k
            yield k, h


def _sample(docs: DataFrame, labels: DataFrame, fold: Column, text_col: str, id_col: str, label_col: str, max_train: int) -> DataFrame:
    """Labelled training rows: text, label; about ``max_train`` at most, by hash of the id."""
    labelled = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    share = min(1.0, max_train / max(1, labelled.count()))
    labelled = labelled.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.filter(fold).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labelled, "id")
    # Dealt and ordered by hash, so that sums are taken in one order whatever order rows arrive in.
    return found.withColumn("h", F.xxhash64("id", "text")).repartition(TASKS, "h").sortWithinPartitions("h", "label").select("text", "label")


#: A block of training rows: labels, how many features each row has, and all features, those of a row in order.
BLOCKS = "labels binary, lengths binary, features binary"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(level=1).compress
    labels: list[int] = []
    held: list[np.ndarray] = []

    def block() -> pd.DataFrame:
        row = [bytes(labels), np.array([len(x) for x in held], np.int32).tobytes(), press(np.diff(np.concatenate(held), prepend=np.int32(0)).tobytes())]
        return pd.DataFrame([row], columns=[x.split()[0] for x in BLOCKS.split(", ")])

    for df in batches:
        for label, (_, parts) in zip(df.label, groupby(present(df.text.tolist()), key=itemgetter(0)), strict=True):
            held.append(np.sort(np.concatenate([h for _, h in parts])).astype(np.int32))
            labels.append(int(label))
            if len(held) == ROWS or sum(map(len, held)) >= FEATURES:
                yield block()
                labels, held = [], []
    if held:
        yield block()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, and of each feature its row and its number."""
    for df in batches:
        for labels, lengths, features in zip(df.labels, df.lengths, df.features, strict=True):
            lengths = np.frombuffer(lengths, np.int32)
            yield np.frombuffer(labels, np.uint8).astype(np.int64), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), np.cumsum(np.frombuffer(zstandard.decompress(features), np.int32), dtype=np.int32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each label and task: the documents and the counts of all buckets, compressed."""
    counts, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for labels, row, column in _blocks(batches):
        n += np.bincount(labels, minlength=2)
        for label in (0, 1):
            counts[label] += np.bincount(column[labels[row] == label], minlength=1 << BITS).astype(np.int32)
    yield pd.DataFrame({"label": [0, 1], "n": n, "counts": [zlib.compress(c.tobytes(), 1) for c in counts]})


def ratios(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-count ratios of all buckets. Smoothing by documents of the labels' shares, so buckets that were not met have 0."""
    extra = SMOOTH * n / n.sum()
    return np.log((counts[1] + extra[1]) / (n[1] + extra[1])) - np.log((counts[0] + extra[0]) / (n[0] + extra[0]))


def train(docs: DataFrame, labels: DataFrame, fold: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_train: int = MAX_TRAIN, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """The weight of each bucket, scaled by its ratio, and the intercept."""
    rows = _sample(docs, labels, fold, text_col, id_col, label_col, max_train)
    # The sample is bounded, so are its tasks; each sends one vector for each label, and one a step.
    table = materialize(rows.mapInPandas(_features, BLOCKS), "toxic-features")
    rows = table.coalesce(TASKS)
    counts, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for row in rows.mapInPandas(_count, "label int, n long, counts binary").toLocalIterator():
        counts[row.label] += np.frombuffer(zlib.decompress(row.counts), np.int32)
        n[row.label] += row.n
    if not n.all():
        discard(table)
        rate = (n[1] + 1) / (n.sum() + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate)))
    scale = ratios(counts, n)
    del counts
    balance, context = 0.5 / n, docs.sparkSession.sparkContext

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective and its gradient; x: weights and then the intercept. Classes weigh alike."""
        held = context.broadcast(((scale * x[:-1]).astype(np.float32), float(x[-1])))

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weight, intercept = held.value
            total, errors, out = 0.0, 0.0, np.zeros(1 << BITS)
            for labels, row, column in _blocks(batches):
                margin = np.bincount(row, weight[column], len(labels)) + intercept
                share = balance[labels]
                error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
                total += float((share * (np.logaddexp(0, margin) - labels * margin)).sum())
                errors += float(error.sum())
                out += np.bincount(column, error[row], 1 << BITS)
            yield pd.DataFrame({"total": [total], "errors": [errors], "slope": [zlib.compress(out.astype(np.float32).tobytes(), 1)]})

        total, found = penalty / n.sum() / 2 * float(x[:-1] @ x[:-1]), np.append(penalty / n.sum() * x[:-1], 0.0)
        # In order of their values, so that sums do not depend on the order in which tasks end.
        for r in sorted(rows.mapInPandas(step, "total double, errors double, slope binary").collect(), key=lambda r: (r.total, r.errors)):
            total += r.total
            found[:-1] += scale * np.frombuffer(zlib.decompress(r.slope), np.float32)
            found[-1] += r.errors
        held.destroy()
        return total, found

    x = minimize(slope, np.zeros((1 << BITS) + 1))
    discard(table)
    return (scale * x[:-1]).astype(np.float32), float(x[-1])


def minimize(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where a smooth convex function is least, by L-BFGS. slope: its value and gradient."""
    value, g = slope(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        q, tried = g.copy(), []
        for s, y, rho in reversed(moves):
            a = rho * float(s @ q)
            q -= a * y
            tried.append(a)
        if moves:
            s, y, rho = moves[-1]
            q /= rho * float(y @ y)
        for (s, y, rho), a in zip(moves, reversed(tried), strict=True):
            q += (a - rho * float(y @ q)) * s
        down, step = float(g @ q), 1.0 if moves else 1.0 / max(1e-12, float(np.abs(g).sum()))
        if down <= 0:
            break
        for _ in range(12):
            there, h = slope(x - step * q)
            if there <= value - 1e-4 * step * down:
                break
            step /= 3
        else:
            break
        s, y = (-step * q).astype(np.float32), (h - g).astype(np.float32)
        if (bend := float(s @ y)) > 0:
            moves = [*moves, (s, y, 1 / bend)][-MEMORY:]
        x, done, value, g = x - step * q, len(moves) > 2 and value - there < GAIN * value, there, h
        if done:
            break
    return x


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``: 0 to 1, higher where label 1 is likelier. fold: true for rows that may be learnt from."""
    small_batches(docs.sparkSession)
    weight, intercept = train(docs, labels, fold, text_col, id_col, label_col)
    held = docs.sparkSession.sparkContext.broadcast(weight)  # a fixed number of buckets

    @F.pandas_udf(T.DoubleType())
    def apply(text: pd.Series) -> pd.Series:
        weight, sums = held.value, np.full(len(text), intercept)
        for k, h in present(text.tolist()):
            sums[k] += weight[h].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return docs.withColumn(score, apply(F.col(text_col)))
