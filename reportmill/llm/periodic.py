"""Runs of words that repeat with a period, and texts without the repetitions.

A run is a stretch of words that has a smallest period q, is as long as max(least, 2 q) at least, and that no neighbouring word extends.
All runs are found, by divide and conquer (Main and Lorentz) over interned words: a run that crosses the middle of a stretch shows in the
Z-functions there, which tell of every place how far it agrees with the middle, forwards and backwards. All stretches of a level are
looked at together, and agreement is read from the ranks of blocks of 2^k words, so it reaches over the stretch's ends: what is found is
extended already. The same interval is found with multiples of its period and in several stretches; one is kept, with the smallest.

A run of period q repeats blocks of half the least length, which cover it. So only stretches that such repeated blocks cover are searched;
that leaves out most of a usual text, and no run.

Defined results: null and empty texts have no words and no runs; ids may be null or repeated, each row has its result; extra columns are
ignored; an empty table gives an empty result; texts are searched whole, in memory that grows with the longest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import WORD, small_batches, words

#: Least length of a run in words; words that are searched at once, about.
LEAST, AT_ONCE = 12, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _covered(ids: np.ndarray, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that blocks of ``gram`` words cover which their text has more than once.

    starts: where texts start, and the number of words last. Blocks are told apart by a hash, which may only cover more."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = text[:n].astype(np.uint64) * _MIX
    for k in range(gram):
        h = (h ^ (h >> np.uint64(29)) ^ ids[k : n + k].astype(np.uint64)) * _MIX
    again = pd.Series(h).duplicated(keep=False).to_numpy() & (text[:n] == text[gram - 1 :])
    depth = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(again)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + gram, -1)
    inside = np.cumsum(depth[:-1]) > 0
    first = np.empty(len(ids), bool)
    first[0] = True
    first[1:] = ~inside[:-1] | (text[1:] != text[:-1])
    last = np.append(first[1:] | ~inside[1:], True)
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def _ranks(x: np.ndarray, longest: int) -> np.ndarray:
    """ranks[k, i]: equal for equal blocks of 2^k words from i. The last word is one of a kind, so blocks cut short there equal no other."""
    out, width = [np.unique(x, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * width <= longest:
        key = out[-1] * (len(x) + 1)
        key[:-width] += out[-1][width:] + 1
        out.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return np.stack([r.astype(np.int32) for r in out])


def _agree(ranks: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from a and b on, or before them: the Z-values."""
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        if back:
            i, j = a - (1 << k), b - (1 << k)
            same = (i >= 0) & (j >= 0) & (ranks[k, np.maximum(i, 0)] == ranks[k, np.maximum(j, 0)])
        else:
            same = ranks[k, a] == ranks[k, b]
        step = same.astype(np.int64) << k
        n += step
        a, b = (a - step, b - step) if back else (a + step, b + step)
    return n


def crossing_runs(x: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs within the stretches [low, high) of x, each between two words that occur nowhere else."""
    ranks = _ranks(x, int((high - low).max()))
    found = [np.zeros((3, 0), np.int64)]
    while len(low := low[(keep := high - low >= least)]):
        high = high[keep]
        middle = (low + high) // 2
        size = high - low + 1
        of = np.repeat(np.arange(len(low)), size)
        y = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
        m = middle[of]
        y, m = y[y != m], m[y != m]
        period = np.abs(y - m)
        # Forwards and backwards together it takes max(q, least - q) words, so one of both takes half of them.
        need = (np.maximum(period, least - period) + 1) // 2
        k = np.minimum(np.log2(need).astype(np.int64), len(ranks) - 1)
        width = 1 << k
        ahead = ranks[k, y] == ranks[k, m]
        behind = ranks[k, np.maximum(y - width, 0)] == ranks[k, np.maximum(m - width, 0)]
        some = np.flatnonzero(ahead | behind)
        y, m, period = y[some], m[some], period[some]
        forward, backward = _agree(ranks, y, m, False), _agree(ranks, y, m, True)
        length = forward + backward + period
        good = (forward + backward >= period) & (length >= least)
        found.append(np.stack([np.minimum(y, m)[good] - backward[good], length[good], period[good]]))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts whose interned words lie behind each other; starts: where texts start, and the number of words last."""
    low, high = _covered(ids, starts, (least + 1) // 2)
    found = [np.zeros((3, 0), np.int64)]
    group = np.cumsum(high - low) // AT_ONCE
    for g in np.unique(group):
        a, b = low[group == g], high[group == g]
        size = b - a
        # Stretches with a word of its own before, between and after them.
        to = np.cumsum(size + 1) - size
        x = np.empty(int(size.sum()) + len(size) + 1, np.int64)
        x[:] = -1 - np.arange(len(x))
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        x[at + np.repeat(to, size)] = ids[at + np.repeat(a, size)]
        start, length, period = crossing_runs(x, to, to + size, least)
        found.append(np.stack([start + (a - to)[np.searchsorted(to, start, "right") - 1], length, period]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


_FOUND = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("start", "length", "period")]).add("collapsed", "string")


def _search(least: int):
    @F.pandas_udf(_FOUND)
    def search(text: pd.Series) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        # Bytes know just the six separators as white space.
        split = [(x or "").encode("utf-8", "surrogatepass").split() for x in text]
        starts = np.cumsum([0, *map(len, split)])
        ids = np.fromiter((index.setdefault(w, len(index)) for x in split for w in x), np.int64, int(starts[-1]))
        start, length, period = runs_of(ids, starts, least)
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = np.cumsum(depth[:-1]) == 0
        cut = np.searchsorted(start, starts)
        rows = []
        for k, found in enumerate(split):
            a, b = cut[k], cut[k + 1]
            if a < b:
                found = [found[i] for i in np.flatnonzero(kept[starts[k] : starts[k + 1]]).tolist()]
            rows.append((start[a:b] - starts[k], length[a:b], period[a:b], b" ".join(found).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row per document: id, runs (array of start, length, period by start, then period; words count from 0) and collapsed, the words that
    no run repeats, joined by one space: of a run the first period stays, unless another run repeats it."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col), _search(least)(F.col(text_col)).alias("f"))
    runs = F.arrays_zip(F.col("f.start").alias("start"), F.col("f.length").alias("length"), F.col("f.period").alias("period"))
    return found.select(F.col(id_col), runs.alias("runs"), F.col("f.collapsed").alias("collapsed"))


def repeat_tail(text: Column, h: Column) -> Column:
    """The words of ``text``, of which the last ones repeat with a period, where h (an unsigned number) is a multiple of 10.

    The text comes back as it is for other h, for a null one, and without words."""
    found = words(text)
    n, g = F.size(found).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = F.slice(found, (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(whole, F.ceil((n - a) / p).cast("int")))
    repeated = F.concat(F.slice(found, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & F.coalesce(text, F.lit("")).rlike(WORD), F.array_join(repeated, " ")).otherwise(text)


SQL = r"""
with c as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
      lambda x, y: list_reduce(range(8), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(x, y)), 4294967295::bigint), 4294967295::bigint) as h from documents),
n as (select *, len(w) as n, h // 10 as g from c),
a as (select *, case when n > 0 then g % n end as a from n),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
t as (select doc_id, n, case when h % 10 = 0 and n > 0 then [w[1 + case when i < a then i else a + (i - a) % p end] for i in range(n)] else w end as t from p),
b as (select doc_id, unnest(range(0, n - 5)) as i, t from t where n >= 12),
grams as (select doc_id, i, array_to_string(t[i + 1 : i + 6], ' ') as gram from b),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i),
islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
found as (select doc_id, min(i) as start, count(*) + 5 + q as length, q from islands group by doc_id, q, island),
runs as (select doc_id, start, length, min(q) as period from found where length >= greatest(12, 2 * q) group by doc_id, start, length),
listed as (select doc_id, list({'s': start, 'l': length, 'p': period} order by start, period) as r, first({'s': start, 'l': length, 'p': period} order by length desc, start, period) as best from runs group by doc_id),
last as (select t.doc_id, t, n, coalesce(r, []) as r, best from t left join listed using (doc_id))
select doc_id, len(r)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length, best.p::bigint as period, (1000 * best.l // best.p)::bigint as exponent_milli,
  sha256(array_to_string(list_transform(r, lambda x: x.s::varchar || ',' || x.l::varchar || ',' || x.p::varchar || chr(10)), '')) as runs_sha256,
  sha256(array_to_string([t[i + 1] for i in range(n) if not list_bool_or([false] || [i >= x.s + x.p and i < x.s + x.l for x in r])], ' ')) as collapsed_sha256 from last
"""
