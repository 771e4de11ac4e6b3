"""Join of texts whose sets of word n-grams are similar, by prefixes under several global orders.

Under any one order of all shingles, two sets of Jaccard similarity t or more share one of the first n - ceil(t n) + 1 shingles of each
(prefix filter). So they share one under every order, and each further order rules out pairs that met by chance.

The first order begins with the shingles of one part of the hash space (``COUNTED``) by the number of sets that have them, which is counted over all
sets; then come the others, and last those that are common in a sample of the texts. A set's prefix is then mostly of shingles that
no other set has, which meet nothing. The further orders are by other hashes. Any orders give right results; these make them cheap.

Filters follow each other. Sets that share a prefix shingle under the first order are tied to the next one by size, and what is tied together
is a group. A group is parted by sketches, which have one or two bits for each shingle and not 64: a bit is the parity of the shingles that fall on it,
so sketches differ in no more bits than sets in shingles, and sets whose sketches differ in more than a link allows are not linked. Sets that
no other one of their group fits go. What is left is parted into the components of those that fit, which are mostly near copies, and only then whole sets
are moved: in the tasks that verify a group, whoever shares a prefix shingle under every further order, fits by size and is not linked yet is compared
by the whole sets.

Large groups are cut, for sketches as for whole sets. First each part is solved alone, with a few sets of its group that all parts get, so that parts of
near copies link up over them. Then blocks of sets that are not linked meet pairwise: every block of a large class with the sets outside of it, but never
with the class itself. So a group of near copies costs in proportion to its size. Sets that meet by chance meet as sketches, of which a part holds many.

Defined results: null texts and texts without words have the empty set, which is linked with nothing, so their component is their own id; null
ids take part, and a component's id is its smallest that is not null (null if there is none); repeated rows get one result each; extra columns
are ignored; an empty table gives an empty result. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import MOST_BROADCAST, discard, join_hot, materialize, n_partitions, small_batches
from reportmill.llm.simhash import SEED, _hashes, components, grouped, shards

#: Words of a shingle, least Jaccard similarity.
WORDS, SIMILARITY = 3, 0.9
#: Texts that are counted to find common shingles, about; rows of a task that ties sets, about.
SAMPLE, TASK_ROWS = 20_000, 500_000
#: Odd factors, one for each order of shingles; share of the hash space whose shingles the first order counts.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
COUNTED = 0.2
#: Shingles that are ordered by their counts in a sample; sets and shingles of a part; sets that all parts of a group get; shingles of a task, about.
COMMON, SET_PART, PART_SHINGLES, PIVOTS, TASK_SHINGLES = 50_000, 4096, 1_000_000, 16, 3_000_000
#: Bits of a sketch, least and most; sets of a part of sketches for each set of a part, and shingles for each shingle.
SKETCH_BITS, SKETCH_SETS, SKETCH_SHINGLES = (64, 1 << 17), 4, 16


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    found = list(_hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Of each place, by a hash's low bits, whether an odd number of shingles falls on it. Places are a power of 2, one or two for each shingle (within SKETCH_BITS)."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << (max(1, len(found)) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one in each row, of sets as they would be with so many words of 64 bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _key(found: np.ndarray) -> int:
    """One value for each set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(found.astype("<u8", copy=False).tobytes(), SEED)


def prefix_length(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Of sets of n shingles in one order of all shingles: two that are as similar share one of so many first ones."""
    n = np.asarray(n)
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def _frequencies(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Counts of shingles; common: sorted shingles and their counts, the others have 0."""
    if not common.size:
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common[0], h), common.shape[1] - 1)
    return np.where(common[0][at] == h, common[1][at], 0)


def prefix(found: np.ndarray, counts: np.ndarray, factor: int, similarity: float) -> np.ndarray:
    """The first shingles of a set under one order; counts: of each, in the sample."""
    order = np.lexsort((found * np.uint64(factor), counts))
    return found[order[: int(prefix_length(len(found), similarity))]]


def first_shingles(found: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a set: the shingles that are counted, those behind them that its prefix has at any rate, and how many more than counted ones it takes
    (below 0: so many of them are left out, those that most sets have)."""
    mixed = found * np.uint64(ORDERS[0])
    own = (counts == 0) & (mixed < np.uint64(int(COUNTED * 2**64)))
    free = int(prefix_length(len(found), similarity)) - int(own.sum())
    rest = np.flatnonzero(~own)
    return found[own], found[rest[np.lexsort((mixed[rest], counts[rest]))][: max(0, free)]], free


def _firsts(common: np.ndarray, similarity: float, shingle: int):
    """The key of a text's set, its size, what the first order needs, and its sketch."""

    @F.pandas_udf(T.StructType().add("fp", "long").add("n", "integer").add("own", T.ArrayType(T.LongType())).add("more", T.ArrayType(T.LongType())).add("free", "integer").add("sketch", "binary"))
    def firsts(text: pd.Series) -> pd.DataFrame:
        rows = []
        for x in text:
            found = shingle_set(x, shingle)
            own, more, free = first_shingles(found, _frequencies(found.view(np.int64), common), similarity)
            rows.append((np.array([_key(found)], np.uint64).view(np.int64)[0], len(found), own.view(np.int64), more.view(np.int64), free, sketch(found).tobytes()))
        return pd.DataFrame(rows, columns=["fp", "n", "own", "more", "free", "sketch"])

    return firsts


def further(found: np.ndarray, common: np.ndarray, similarity: float) -> list[np.ndarray]:
    counts = _frequencies(found.view(np.int64), common)
    return [prefix(found, counts, factor, similarity) for factor in ORDERS[1:]]


def first_postings(sets: DataFrame) -> DataFrame:
    """sets: fp, n, own, more, free, each set once. h, n, fp: the shingles of the prefixes under the first order that other sets may have.

    Common shingles are not counted, so no shingle that is has more than a small share of all sets."""
    counted = sets.select("fp", "n", "free", F.explode("own").alias("h")).withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
    own = Window.partitionBy("fp")
    ranked = counted.withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("shared", F.count("*").over(own))
    # Shingles that no other set has come first.
    kept = ranked.filter(F.col("rank") - F.col("shared") <= F.col("free")).select("h", "n", "fp")
    return kept.unionAll(sets.select(F.explode("more").alias("h"), "n", "fp"))


def _sets(shingle: int):
    @F.pandas_udf(T.StructType().add("fp", "long").add("hashes", "binary"))
    def sets(text: pd.Series) -> pd.DataFrame:
        found = [shingle_set(x, shingle) for x in text]
        return pd.DataFrame({"fp": np.array([_key(x) for x in found], np.uint64).view(np.int64), "hashes": [x.astype("<u8", copy=False).tobytes() for x in found]})

    return sets


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """texts: text, row (a hash of it). The most frequent shingles of a sample, sorted, and their counts."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def listed(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, shingle).view(np.int64) for x in text])

    share = max(1, texts.count() // SAMPLE)
    counted = texts.filter(F.pmod("row", F.lit(share)) == 0).select(F.explode(listed("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    return np.array(sorted((r.h, r.n) for r in counted.orderBy(F.desc("n"), "h").limit(COMMON).collect()), np.int64).reshape(-1, 2).T


def _ties(df: pd.DataFrame, similarity: float) -> np.ndarray:
    """Places of rows, sorted by group, shingle and size, that tie to the next one."""
    g, h, n, fp = (df[c].to_numpy() for c in ("g", "h", "n", "fp"))
    return np.flatnonzero((g[1:] == g[:-1]) & (h[1:] == h[:-1]) & (fp[1:] != fp[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9))


def tied(postings: DataFrame, similarity: float) -> DataFrame:
    """postings: g, h, n, fp. Edges (a, b) that tie each set to the next by size of its group and shingle, where their sizes allow a link.

    Rows are dealt by ranges, so one shingle that very many sets have is cut over tasks; each task's first and last row tie it to its
    neighbours. Any two sets of a group and shingle whose sizes allow a link are tied by others between them."""
    schema = "a long, b long, g long, h long, n long, fp long"

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for df in batches:
            first = df.iloc[:1] if first is None and len(df) else first
            df = df if last is None else pd.concat([last, df], ignore_index=True)
            at, fp = _ties(df, similarity), df.fp.to_numpy()
            a, b = fp[at], fp[at + 1]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates().assign(g=None, h=None, n=None, fp=None)
            last = df.iloc[-1:] if len(df) else last
        if first is not None:
            yield pd.concat([first, last]).assign(a=None, b=None)[["a", "b", "g", "h", "n", "fp"]]

    tasks = max(n_partitions(postings.sparkSession), -(-postings.count() // TASK_ROWS))
    key = ["g", "h", "n", "fp"]
    found = materialize(postings.repartitionByRange(tasks, *key).sortWithinPartitions(*key).mapInPandas(chain, schema), "jaccard-ties")
    # Two rows for each task at most.
    ends = pd.DataFrame([tuple(r) for r in found.filter("a is null").select(*key).collect()], columns=key).sort_values(key, ignore_index=True)
    at, fp = _ties(ends, similarity), ends.fp.to_numpy()
    seams = [(int(min(fp[k], fp[k + 1])), int(max(fp[k], fp[k + 1]))) for k in at]
    edges = found.filter("a is not null").select("a", "b")
    return (edges.unionAll(postings.sparkSession.createDataFrame(seams, "a long, b long")) if seams else edges).distinct()


def grouped_sets(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points with ``g``, the group that edges tie them to; those tied to nothing go."""
    root = components(edges)
    nodes = root.select("node", F.col("root").alias("g")).unionAll(root.select(F.col("root").alias("node"), F.col("root").alias("g")).distinct())
    return points.drop("g").join(nodes, points.fp == nodes.node).drop("node")


def linked_sets(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], similarity: float, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) of a forest whose components are those of all pairs of sets that are as similar.

    prefixes: of each set, under each order. classes: of each set, what it is linked to already; only edges between classes are returned."""
    by_size = np.argsort([len(x) for x in sets], kind="stable")
    n = np.array([len(sets[k]) for k in by_size], np.int64)
    if not n.sum():
        return []
    distinct, shingle = np.unique(np.concatenate([sets[k] for k in by_size]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)])
    least = np.searchsorted(n, similarity * n - 1e-9)
    lists = []
    for order in range(len(prefixes[0])):
        held = [prefixes[k][order] for k in by_size]
        owner = np.repeat(np.arange(len(n)), [len(x) for x in held])
        h = np.searchsorted(distinct, np.concatenate(held))  # all prefixes are of the sets
        by = np.lexsort((owner, h))
        listed, of = h[by], owner[by]
        # For each set its places in the lists of its prefix's shingles, and where these begin.
        places = np.argsort(of, kind="stable")
        lists.append((of, np.searchsorted(listed, listed), places, np.searchsorted(of[places], np.arange(len(n) + 1))))
    label = np.arange(len(n)) if classes is None else np.unique(classes, return_inverse=True)[1][by_size]
    marked, edges = np.zeros(len(distinct), bool), []
    for x in range(1, len(n)):
        if least[x] == x:
            continue
        near = None
        for of, begin, places, cuts in lists:
            at = places[cuts[x] : cuts[x + 1]]
            each = at - begin[at]
            total = int(each.sum())
            if not total:
                near = np.zeros(0, np.int64)
                break
            shared = np.bincount(of[np.arange(total) + np.repeat(begin[at] - np.cumsum(each) + each, each)], minlength=x)
            shared[: least[x]] = 0
            near = np.flatnonzero(shared) if near is None else near[shared[near] > 0]
            near = near[label[near] != label[x]]
            if not len(near):
                break
        if not len(near):
            continue
        mine = shingle[starts[x] : starts[x + 1]]
        marked[mine] = True
        step = 8
        while len(near := near[label[near] != label[x]]):
            step = min(2 * step, max(1, (1 << 20) // int(n[x])))
            y, near = near[-step:], near[:-step]
            ends = np.cumsum(n[y])
            within = marked[shingle[np.arange(ends[-1]) + np.repeat(starts[y] - ends + n[y], n[y])]]
            both = np.add.reduceat(within, ends - n[y], dtype=np.int64)
            for z in y[both >= similarity * (n[x] + n[y] - both) - 1e-9].tolist():
                if label[z] != label[x]:
                    label[label == label[z]] = label[x]
                    edges.append((int(by_size[x]), int(by_size[z])))
        marked[mine] = False
    return edges


def fitting_sketches(sketches: list[np.ndarray], n: np.ndarray, similarity: float, classes: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a forest whose components are those of all pairs whose sizes n and sketches allow a link.

    classes: of each set, what it is tied to already; only edges between classes are returned."""
    by_size = np.argsort(n, kind="stable")
    n = np.asarray(n, np.int64)[by_size]
    least = np.searchsorted(n, similarity * n - 1e-9)
    label = np.unique(classes, return_inverse=True)[1][by_size]
    # Larger sets have as many words or more: a matrix for each number of words, of rows from starts on.
    words = np.array([len(sketches[k]) for k in by_size])
    kinds, starts = np.unique(words, return_index=True)
    ends = [*starts[1:], len(n)]
    held = [np.array([sketches[k] for k in by_size[i:j]]) for i, j in zip(starts, ends, strict=True)]
    edges = []
    for x in range(1, len(n)):
        mine = held[np.searchsorted(kinds, words[x])][x - starts[np.searchsorted(kinds, words[x])]][None]
        for kind, start, end, rows in zip(kinds.tolist(), starts.tolist(), ends, held, strict=True):
            low, high = max(start, int(least[x])), min(end, x)
            if low >= high:
                continue
            own, step = folded(mine, kind), 64
            # The nearest by size first: of near copies these tie soon, and the others then have the label of x.
            while low < high:
                step = min(8 * step, max(64, (1 << 21) // kind))
                at = max(low, high - step)
                y = at + np.flatnonzero(label[at:high] != label[x])
                high = at
                if not len(y):
                    continue
                apart = np.bitwise_count(rows[y - start] ^ own).sum(1, dtype=np.int64)
                for z in y[(1 + similarity) * apart <= (1 - similarity) * (n[x] + n[y]) + 1e-6].tolist():
                    if label[z] != label[x]:
                        label[label == label[z]] = label[x]
                        edges.append((int(by_size[x]), int(by_size[z])))
    return edges


def _fitting(similarity: float):
    """Of parts, one after the other, the edges between sets whose sketches fit."""

    def edges(df: pd.DataFrame) -> np.ndarray:
        place, found = df[["g", "low", "high"]].to_numpy(), []
        for at in np.split(np.arange(len(df)), np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1):
            part = df.iloc[at]
            fp = part.fp.to_numpy()
            pairs = fitting_sketches([np.frombuffer(x, "<u8") for x in part.held], part.n.to_numpy(), similarity, part["class"].to_numpy())
            found.append(fp[np.array(pairs, np.int64).reshape(-1, 2)])
        return np.concatenate(found)

    return edges


def _similar(common: np.ndarray, similarity: float):
    """Of parts, all at once, the edges between sets that are as similar."""

    def edges(df: pd.DataFrame) -> np.ndarray:
        df = df.drop_duplicates("fp")
        sets = [np.frombuffer(x, "<u8") for x in df.held]
        found = linked_sets(sets, [further(x, common, similarity) for x in sets], similarity, df["class"].to_numpy())
        return df.fp.to_numpy()[np.array(found, np.int64).reshape(-1, 2)]

    return edges


def _solved(placed: DataFrame, edges: Callable[[pd.DataFrame], np.ndarray], shingles: int, scale: int) -> DataFrame:
    """placed: g, low, high, fp, n, class, held, of about so many shingles in all. What ``edges`` finds between classes within each (g, low, high).

    scale: how many times PART_SHINGLES a part has."""
    place = ["g", "low", "high"]
    tasks = max(n_partitions(placed.sparkSession), -(-shingles // (TASK_SHINGLES * scale)))
    dealt = placed.repartition(tasks, *place).sortWithinPartitions(*place)
    most = PART_SHINGLES * scale

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for many, shard in shards(batches, place):
            # Whole shards, as many at once as have about a part's shingles.
            weight = np.cumsum(np.bincount(shard, many.n))
            group = np.searchsorted(np.arange(1, 2 + int(weight[-1]) // most) * most, weight, "left")[shard]
            for k in np.unique(group):
                x, y = edges(many.iloc[np.flatnonzero(group == k)]).T
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.mapInPandas(search, "a long, b long").filter("a <> b").distinct()


def _parts(sets: Column, shingles: Column, most: int, scale: int) -> Column:
    return F.ceil(F.greatest(sets / most, shingles / (PART_SHINGLES * scale))).cast("int")


def verified(held: DataFrame, members: DataFrame, search: Callable[[pd.DataFrame], np.ndarray], most: int, scale: int = 1) -> DataFrame:
    """held: fp, held; members: fp, n, g; most: sets of a part; scale: how many times PART_SHINGLES it has. Edges (a, b) whose components are those of all
    pairs in one group that ``search`` finds."""
    sizes = members.groupBy("g").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = sizes.select("g", F.col("sets").alias("n"), "sets", _parts(F.col("sets"), F.col("shingles"), most, scale).alias("parts"))
    members = materialize(join_hot(members.withColumnRenamed("n", "size"), sizes, ["g"], members.count()).select("fp", "size", "g", "sets", "parts"), "jaccard-members")
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pivot = F.pmod(F.xxhash64("fp", F.lit("pivot")), F.col("sets")) < PIVOTS
    alone = held.join(members, "fp").withColumn("low", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    total = int(members.agg(F.sum("size")).first()[0] or 0)
    edges = materialize(_solved(alone.select("g", "low", F.col("low").alias("high"), "fp", F.col("size").alias("n"), F.col("fp").alias("class"), "held"), search, total, scale), "jaccard-alone")
    large = members.filter("parts > 1")
    if large.isEmpty():
        return edges
    # Classes so far: large ones have blocks of their own, the others of a group share blocks.
    root = components(edges)
    classes = materialize(large.join(root, large.fp == root.node, "left").select("fp", "size", "g", F.coalesce("root", "fp").alias("class")), "jaccard-classes")
    weights = classes.groupBy("g", "class").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).withColumn("own", _parts(2 * F.col("n"), 2 * F.col("shingles"), most, scale) > 1)
    groups = weights.groupBy("g").agg(F.count("*").alias("classes"), _parts(F.sum(F.when(~F.col("own"), F.col("n"))), F.sum(F.when(~F.col("own"), F.col("shingles"))), most, scale).alias("bins"))
    weights = weights.join(groups.filter("classes > 1"), "g").withColumn("blocks", F.when(F.col("own"), _parts(F.col("n"), F.col("shingles"), most, scale)).otherwise(F.col("bins")))
    weights = weights.select("g", F.col("class"), "n", "own", "blocks")
    # A block's name: its class and number. A group has about as many as it has sets by SET_PART.
    owner = [(~F.col("own")).alias("shared"), F.when(F.col("own"), F.col("class")).otherwise(F.lit(0)).alias("class")]
    names = weights.select("g", "n", F.when(F.col("own"), F.col("class")).otherwise(F.lit(0)).alias("class"), (~F.col("own")).alias("shared"), "blocks")
    names = names.groupBy("g", "class", "shared").agg(F.sum("n").alias("n"), F.max("blocks").alias("blocks")).select("g", "n", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct("shared", "class", k.alias("k"))).alias("names"))
    names = names.groupBy("g").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("names"))).alias("names"))
    rows = classes.count()
    dealt = join_hot(join_hot(classes, weights, ["g", "class"], rows).drop("n"), names, ["g"], rows)
    dealt = dealt.withColumn("mine", F.struct(*owner, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("k")))
    meets = F.filter(F.sequence(F.lit(1), F.size("names")), lambda k: (F.element_at("names", k)["shared"] & F.col("mine.shared")) | (F.element_at("names", k)["shared"] != F.col("mine.shared")) | (F.element_at("names", k)["class"] != F.col("mine.class")))
    at = F.array_position("names", F.col("mine")).cast("int")
    dealt = dealt.select("fp", "size", "g", "class", at.alias("at"), F.explode(meets).alias("other"))
    dealt = materialize(dealt.select("fp", F.col("size").alias("n"), "g", "class", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high")), "jaccard-blocks")
    total = int(dealt.agg(F.sum("n")).first()[0] or 0)
    across = _solved(held.join(dealt, "fp").select("g", "low", "high", "fp", "n", "class", "held"), search, total, scale)
    return materialize(edges.unionAll(across), "jaccard-edges")


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, text_col: str = "text", id_col: str = "doc_id", part: int | None = None, empty: bool = False) -> DataFrame:
    """One row per document: id, n_shingles (long) and component_id, the smallest id that links of sets reach.

    part: sets of a part of a group (SET_PART unless given). empty: whether empty sets are linked with each other."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    common = common_shingles(texts, shingle)
    found = texts.select("id", "row", _firsts(common, similarity, shingle)("text").alias("s"))
    marked = materialize(found.select("id", "row", "s.*").withColumn("uid", F.monotonically_increasing_id()), "jaccard-firsts")
    full = marked if empty else marked.filter("n > 0")
    points = materialize(full.groupBy("fp").agg(F.min("id").alias("first"), F.min("uid").alias("uid"), F.min("row").alias("row"), F.min("n").alias("n"), F.count("*").alias("docs")), "jaccard-points")
    # Of equal sets one stands for all.
    sets = full.join(points.select("uid"), "uid", "left_semi").select("fp", "n", "own", "more", "free")
    postings = materialize(first_postings(sets), "jaccard-postings")
    tied_sets = materialize(grouped_sets(points.select("fp", "row", "n"), tied(postings.select(F.lit(0).cast("long").alias("g"), "h", "n", "fp"), similarity)), "jaccard-tied")
    discard(postings)
    most = part or SET_PART
    # Groups are named by a set of theirs, so the names of their parts are no others'.
    sketches = full.join(points.select("uid"), "uid", "left_semi").select("fp", F.col("sketch").alias("held"))
    fit = verified(sketches, tied_sets.drop("row"), _fitting(similarity), most * SKETCH_SETS, SKETCH_SHINGLES)
    members = materialize(grouped_sets(tied_sets, fit), "jaccard-members")
    # Only what is left in groups is read again.
    rows = members.select("row")
    read = materialize(texts.select("row", "text").join(F.broadcast(rows) if members.count() <= MOST_BROADCAST else rows.distinct(), "row", "left_semi"), "jaccard-texts")
    held = materialize(read.select(_sets(shingle)("text").alias("s")).groupBy("s.fp").agg(F.first("s.hashes").alias("held")), "jaccard-held")
    discard(read)
    edges = verified(held, members.drop("row"), _similar(common, similarity), most)
    discard(held)
    named = grouped(full.select(F.struct("id", "n").alias("id"), "fp"), points.select("fp", "first", "docs"), edges, "of")
    named = named.select(F.col("of.id").alias(id_col), F.col("of.n").alias("n_shingles"), "component_id")
    if empty:
        return named
    return named.unionAll(marked.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct([array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)])) end as s from w),
k as (select s, min(doc_id) as k, len(s) as n from s where len(s) > 0 group by s),
t as (select k, n, unnest(s) as t from k),
o as (select k, n, t, row_number() over (partition by k order by df, t) as place from (select *, count(*) over (partition by t) as df from t)),
f as (select * from o where place <= n - (9 * n + 9) // 10 + 1),
c as (select distinct a.k as a, b.k as b, a.n as na, b.n as nb from f a join f b on a.t = b.t and a.k < b.k and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
v as (select a, b, na + nb as total, count(*) as common from c join t x on x.k = a join t y on y.k = b and y.t = x.t group by a, b, total),
e as (select a, b from v where 10 * common >= 9 * (total - common)),
l as (select a, b from e union all select b, a from e),
r as (select k, k as node from k union select r.k, l.b from r join l on r.node = l.a),
m as (select k, min(node) as component_id from r group by k)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.component_id, s.doc_id) as component_id from s left join k on s.s = k.s and len(s.s) > 0 left join m on m.k = k.k
"""
