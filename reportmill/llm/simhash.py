"""SimHash near-duplicates by vantage-point trees.

Fingerprints within ``RADIUS`` differing bits are linked; the groups are the connected components. Only distinct fingerprints are searched.

A tree over all 64 bits hardly prunes: distances between unrelated fingerprints gather at 32, four standard deviations are 16, and
two of three points lie within the radius of any boundary (figures in the README). The bits are therefore dealt to blocks and
there is one tree for each choice of blocks. Of ``RADIUS`` differing bits, some choice holds its share or less, so in its
tree's distance (bits that differ within these blocks) every link is within ``reach``, which is 1. There the triangle bound parts all
but the points next to a boundary. The number of blocks grows with the number of fingerprints.

The trees are built on the driver from a bounded sample of fingerprints. A node has a vantage point and a distance: nearer points go
to one side, the others to the other side, and points nearer by up to ``reach`` to both, since their partners may lie beyond. Each
fingerprint is sent down all trees to the shards that it may have partners in, overlaps included, and the tree goes on within each shard,
where branches are pruned by the same bound, until leaves compare all 64 bits. No link is lost: the sample decides how even
shards are, not what they find. A shard that is too large for one task is cut into parts and every pair of parts is a task of its own.

Of the links found in a shard a spanning forest leaves the task. Components are found by alternating star contractions on those
edges; centres of very many edges are joined by broadcast. Nothing of all documents is collected.

Defined results: null text is empty; texts without words have fingerprint 0, which links like any other; null ids take part, and
a component's id is its smallest id that is not null (null if there is none); repeated rows get one result each; extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import discard, join_hot, materialize, n_partitions, one_of_each

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Points of a leaf, which are compared with each other; points of a shard, about; points of a part of a shard that could not be split; rows of a task of the search, about.
LEAF, SHARD, PART, TASK_ROWS = 256, 4096, 8192, 200_000
#: A node is split where that leaves so much of its comparisons at most; else copies would pile up in dense groups.
WORTH = 0.78
#: Fingerprints that the trees are built from (a quarter of all at most), about, and never more than twice the second (8 bytes each, on the driver).
LEAST_SAMPLE, MOST_SAMPLE = 1 << 16, 1 << 20
#: Edges from which on centres of many edges are joined by broadcast.
MANY_EDGES = 200_000
#: Shingles that are hashed and counted at once.
BLOCK = 1 << 16


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in blocks; nothing for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII letters and white space only
    if not words:
        return
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=False)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half of the shingles' hashes, repeats included."""
    counts, n = np.zeros(64, np.int64), 0
    for h in _hashes(text, shingle):
        n += len(h)
        bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # that many ones fit in a byte
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def close_pairs(points: np.ndarray, radius: int = RADIUS, mask: int = (1 << 64) - 1, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of the pairs within the radius of which the bits in ``mask`` differ by ``reach`` or less, and perhaps of others within the radius."""
    found: list[np.ndarray] = []
    reach, seen = radius if reach is None else reach, points & np.uint64(mask)
    # members are searched among themselves, guests only against members: their pairs among each other are met elsewhere
    stack = [(np.arange(len(points)), np.zeros(0, np.int64), 0)]
    while stack:
        members, guests, depth = stack.pop()
        if len(members) <= LEAF or depth > 40:
            for at in range(0, len(members), LEAF):
                a = members[at : at + LEAF]
                b = np.concatenate([members[at:], guests])
                for bt in range(0, len(b), 8192):
                    i, j = np.nonzero(np.bitwise_count(points[a, None] ^ points[None, b[bt : bt + 8192]]) <= radius)
                    found.append(np.stack([a[i], b[bt : bt + 8192][j]]))
            continue
        vantage = seen[members[(depth * 7919) % len(members)]]
        own = np.bitwise_count(seen[members] ^ vantage).astype(np.int64)
        middle = boundary(own)
        if not middle:
            stack.append((members, guests, 99))
            continue
        inside, guest = own < middle, np.bitwise_count(seen[guests] ^ vantage).astype(np.int64)
        near_in = members[inside & (own >= middle - reach)]  # may reach over the boundary: guests outside
        stack.append((members[inside], guests[guest < middle + reach], depth + 1))
        stack.append((members[~inside], np.concatenate([near_in, guests[guest >= middle - reach]]), depth + 1))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    i, j = np.minimum(i, j), np.maximum(i, j)
    return i[i < j], j[i < j]


def boundary(distance: np.ndarray) -> int:
    """About the median: some distances are less and some are not; 0 if all are equal."""
    least, most = int(distance.min()), int(distance.max())
    return 0 if least == most else min(max(int(np.median(distance)), least + 1), most)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes can reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label, new[np.arange(n)])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Indices of the edges of a forest of least distances (each component ties its closest edge, until none is left)."""
    order = np.argsort(distance, kind="stable")
    i, j, label, taken = i[order], j[order], np.arange(n), [np.zeros(0, np.int64)]
    at = np.arange(len(order))
    while True:
        at = at[label[i[at]] != label[j[at]]]
        if not len(at):
            return order[np.concatenate(taken)]
        best = np.full(n, len(order))
        np.minimum.at(best, label[i[at]], at)
        np.minimum.at(best, label[j[at]], at)
        best = np.unique(best[best < len(order)])
        taken.append(best)
        label = roots(n, label[i[best]], label[j[best]])[label]


@dataclass(frozen=True)
class Tree:
    """Nodes of a vantage-point tree over the bits in ``mask``: inner and outer are nodes, or shards as -1 - number; parts of each shard."""

    mask: int
    reach: int
    vantage: np.ndarray
    middle: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    parts: np.ndarray

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``points`` and a shard for each; points near a boundary go to both sides."""
        who = np.arange(len(points))
        if not len(self.vantage):
            return who, np.zeros(len(points), np.int64)
        seen, at, done = points & np.uint64(self.mask), np.zeros(len(points), np.int64), []
        while len(who):
            d, middle = np.bitwise_count(seen[who] ^ self.vantage[at]).astype(np.int64), self.middle[at]
            inside, outside = d < middle, d >= middle - self.reach
            who, at = np.concatenate([who[inside], who[outside]]), np.concatenate([self.inner[at[inside]], self.outer[at[outside]]])
            done.append((who[at < 0], -1 - at[at < 0]))
            who, at = who[at >= 0], at[at >= 0]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def grow(sample: np.ndarray, mask: int, reach: int, scale: float, shard: int = SHARD, part: int = PART) -> Tree:
    """A tree of shards of about ``shard`` points, each point of the sample standing for ``scale``."""
    vantage, middle, inner, outer, parts = [], [], [], [], []
    seen = sample & np.uint64(mask)
    stack: list[tuple[np.ndarray, list | None, int]] = [(np.arange(len(sample)), None, 0)]  # members, and where their node's number is to be put
    while stack:
        members, into, at = stack.pop()
        number = None
        if len(members) * scale > shard and len(members) > 8:
            best = None
            for k in range(3):  # of some vantage points the one that sends fewest to both sides
                v = seen[members[(len(vantage) * 7919 + k * 104729) % len(members)]]
                d = np.bitwise_count(seen[members] ^ v).astype(np.int64)
                for m in range(boundary(d), min(boundary(d) + 2, int(d.max()) + 1)):
                    work = float((d < m).mean() ** 2 + (d >= m - reach).mean() ** 2)  # comparisons that the split leaves
                    if m and (best is None or work < best[0]):
                        best = (work, v, m, d)
            if best and best[0] < WORTH:
                _, v, m, d = best
                number = len(vantage)
                vantage.append(v)
                middle.append(m)
                inner.append(0)
                outer.append(0)
                stack += [(members[d < m], inner, number), (members[d >= m - reach], outer, number)]
        if number is None:
            number = -1 - len(parts)
            parts.append(max(1, ceil(len(members) * scale / part)) if len(members) * scale > shard * 2 else 1)
        if into is not None:
            into[at] = number
    return Tree(mask, reach, np.array(vantage, np.uint64), np.array(middle, np.int64), np.array(inner, np.int64), np.array(outer, np.int64), np.array(parts, np.int64))


def dealing(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Blocks, and how many of them a tree looks at, for n fingerprints: the least work of those with a reach of 1."""

    def work(blocks: int, chosen: int) -> float:
        bits = 64 * chosen / blocks
        both = 0.8 / sqrt(bits)  # one standard deviation is half the root of the bits
        levels = max(0.0, min(log(max(n, LEAF) / LEAF) / -log((1 + both) / 2), bits))
        return comb(blocks, chosen) * (1 + both) ** levels * (40 + n * ((1 + both) / 2) ** levels / 2)

    return min(((b, s) for b in range(3, 9) for s in range(1, b) if radius * s // b == 1), key=lambda x: work(*x))


def masks(blocks: int, chosen: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(part[k] for k in some) for some in combinations(range(blocks), chosen)]


def plant(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[Tree]:
    """The trees for n fingerprints of which ``sample`` is a part."""
    blocks, chosen = dealing(n, radius)
    return [grow(sample, m, radius * chosen // blocks, n / max(1, len(sample)), SHARD, PART) for m in masks(blocks, chosen)]


def link_fingerprints(points: DataFrame, n: int) -> DataFrame:
    """points: fp, distinct, n of them. Edges (a, b) whose components are those of all pairs within the radius."""
    spark = points.sparkSession
    wanted = min(MOST_SAMPLE, max(LEAST_SAMPLE, n // 256))
    share = min(0.25, wanted / max(1, n))
    drawn = points.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * MOST_SAMPLE)
    sample = np.sort(np.array([r.fp for r in drawn.toLocalIterator()], np.int64)).view(np.uint64)
    trees = plant(sample, n)
    rows = sum(len(t.route(sample)[0]) for t in trees) * n / max(1, len(sample))
    held = spark.sparkContext.broadcast(trees)  # fewer nodes than the sample has points

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = df.fp.to_numpy().view(np.uint64)
            for k, tree in enumerate(held.value):
                who, shard = tree.route(x)
                parts = tree.parts[shard]
                own = ((x[who] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts
                # A part meets itself and every other part in a task of its own.
                row = np.repeat(np.arange(len(who)), parts)
                other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                low, high = np.minimum(other, own[row]), np.maximum(other, own[row])
                yield pd.DataFrame({"fp": x[who[row]].view(np.int64), "tree": np.int32(k), "shard": shard[row].astype(np.int32), "low": low.astype(np.int32), "high": high.astype(np.int32)})

    placed = points.select("fp").mapInPandas(place, "fp long, tree int, shard int, low int, high int")
    dealt = placed.repartition(max(n_partitions(spark), ceil(rows / TASK_ROWS)), *SHARDS).sortWithinPartitions(*SHARDS)
    views = [(t.mask, t.reach) for t in trees]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, shard in shards(batches, SHARDS):
            fp, tree = df.fp.to_numpy(), df.tree.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(shard)), strict=True):
                mine = fp[a:b]
                i, j = close_pairs(mine.view(np.uint64), RADIUS, *views[tree[a]])
                kept = forest(len(mine), i, j, np.zeros(len(i), np.int64))
                x, y = mine[i[kept]], mine[j[kept]]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.mapInPandas(search, "a long, b long").distinct()


SHARDS = ["tree", "shard", "low", "high"]


def shards(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows and the number of their shard, many whole shards at once."""
    held = None
    for df in batches:
        held = df if held is None else pd.concat([held, df], ignore_index=True)
        key = held[columns].to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(new):
            done = new[-1]
            yield held.iloc[:done], np.repeat(np.arange(len(new)), np.diff(np.concatenate([[0], new])))
            held = held.iloc[done:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.zeros(len(held), np.int64)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Each node that is not the smallest of its component, with that smallest: node, root.

    Large-star and small-star steps in turn: every node's larger, then its smaller neighbours are tied to the smallest
    neighbour, until nothing changes. Minima combine before the shuffle; centres of very many edges are joined by broadcast."""

    def told(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
        return join_hot(edges, least, ["a"], total).drop("n") if total > MANY_EDGES else edges.join(least.drop("n"), "a")

    def step(edges: DataFrame, total: int) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n"))
        large = told(both, least, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        small = told(large, least, total).select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        return small.filter("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialize(edges.filter("a <> b"), "simhash-edges")
    seen = None
    while (now := state(edges)) != seen:
        seen, old = now, edges
        edges = materialize(step(old, now[0]), "simhash-edges")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(marked: DataFrame, points: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """marked: id, fp; points: fp, first, docs (rows of it). Each row of ``marked`` with its component's id.

    Only linked fingerprints need their component's smallest id; the others keep their own."""
    root = components(edges)
    linked = root.unionAll(root.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(points.join(linked, points.fp == linked.node).select("fp", "first", "root"), "simhash-linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(linked.select("fp", "root"), ids, ["root"], linked.count()).select("fp", "component_id", F.lit(True).alias("linked"))
    named = points.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), F.col("docs").alias("n"))
    named = materialize(named, "simhash-named")
    return join_hot(marked, named, ["fp"], marked.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Links by bits. One row per document: id, fp (long), component_id."""
    marked = materialize(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")), "simhash")
    points = materialize(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("docs")), "simhash-points")
    return grouped(marked, points, link_fingerprints(points.select("fp"), points.count()), id_col)


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns, as :func:`common.one_of_each` takes it."""
    return one_of_each(docs, lambda keyed: near_dedup(keyed, "text", "key"), text_col, id_col)
