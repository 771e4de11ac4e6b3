"""Removal of repeated passages by a distributed sparse suffix array.

A byte goes if a ``LENGTH``-byte string (window) that covers it also starts elsewhere. Every window holds one
anchor: the position of its smallest hash of ``GRAM`` bytes, which depends on the window's content only. So equal windows have
equal suffixes from their anchors on and equal text before them, and only suffixes at anchors, about one in 170, need sorting.
Consecutive windows with one anchor make a segment.

1. Each document yields its segments as digests: the anchor's gram (``gram``) and the whole segment (``digest``).
2. Per gram: segments that all agree are decided by their number. A gram that occurs once repeats nothing; only grams with
   differing segments are left, and of these one representative of each (gram, digest).
3. The representatives' suffixes are range-partitioned by their leading bytes with sampled splitters. Each bucket sorts its suffixes,
   and the reversed texts before the anchors, by multikey quicksort; two windows are equal if they lie in one run of both orders
   at the windows' depths, which longest common prefixes of neighbours tell exactly. Splitters keep a gram together unless it has more
   than ``BUCKET_ROWS`` representatives; the windows of such a gram, where it is a bucket's first or last, are compared across boundaries
   by 128-bit digests.
4. Repeated windows go back to all segments that a representative stands for, and each document's spans are merged and cut.

The same steps run over words at once: there the letters are words (by a 64-bit hash), windows have ``PASSAGE`` words, and a window counts
only if it also occurs in another document. Both views share every shuffle; the last bit of ``gram`` tells them apart.

Texts are handled in blocks of ``BLOCK`` letters with overlap; a segment cut by a block's end has two digests and meets the
others in step 3. Grams and segments with very many rows are joined by broadcast: there is a bounded number of them.

Defined results: null text is empty; texts shorter than a window lose nothing; repeated rows (same id and text) are
copies of each other and give equal rows, but are one document where passages across documents are sought; null ids take part; extra columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import discard, join_hot, materialize, n_partitions, small_batches

LENGTH, GRAM, BLOCK = 400, 64, 1 << 18
#: Words of a passage, so over 50, and of its grams.
PASSAGE, WORD_GRAM = 51, 8
#: Documents of a batch that are taken apart at once.
SLICE = 256
#: Representatives of a bucket, about.
BUCKET_ROWS = 8000
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.cumprod(x)
    return _POWERS[base][:n]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window's start, and each position's gram hash."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULT, n), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = length - gram + 1  # grams of a window
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first
    m = -(-len(key) // width) * width
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64), h


@dataclass(frozen=True)
class View:
    """How texts are read: letters of ``unit`` bytes, windows of ``length`` letters with grams of ``gram``. number: the last bit of a gram."""

    number: int
    unit: int
    length: int
    gram: int

    def letters(self, data: bytes) -> np.ndarray:
        if self.unit == 1:
            return np.frombuffer(data, np.uint8)
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, data.split()), np.uint64)  # bytes know ASCII white space only


BYTES, WORDS = View(0, 1, LENGTH, GRAM), View(1, 8, PASSAGE, WORD_GRAM)
VIEWS = (BYTES, WORDS)
#: Shorter texts have no window of either view: the least passage is of one-letter words.
SHORTEST = min(LENGTH, 2 * PASSAGE - 1)

SEGMENTS = "id long, text_hash long, gram long, digest long, start long, windows int, lead int"


def _texts(df: pd.DataFrame) -> Iterator[tuple[object, bytes]]:
    for id_, text in zip(df.id, df.text, strict=True):
        yield id_, (text or "").encode("utf-8", "surrogatepass")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for df in (df.iloc[k : k + SLICE] for df in batches for k in range(0, len(df), SLICE)):
        docs = [(id_, data) for id_, data in _texts(df) if len(data) >= SHORTEST]
        hashes = np.array([digest(x) for _, x in docs], np.uint64).view(np.int64)
        ids = pd.array([None if pd.isna(x) else x for x, _ in docs], "Int64")
        for view in VIEWS:
            for doc, offset, ends, buffer in _blocks((view.letters(x) for _, x in docs), view.length):
                anchor, h = anchors(buffer, view.length, view.gram)
                starts = np.concatenate([[0], ends[:-1]])
                # Windows that reach over a piece's end belong to no document.
                valid = np.zeros(len(anchor), np.int8)
                for a, b in zip(starts, ends, strict=True):
                    valid[a : b - view.length + 1] = 1
                piece = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
                cut = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (piece[1:] != piece[:-1])
                new = np.flatnonzero((valid == 1) & np.concatenate([[True], cut]))
                stop = np.flatnonzero((valid == 1) & np.concatenate([cut, [True]])) + 1
                raw, u = memoryview(buffer.view(np.uint8)), view.unit
                marks = np.array([digest(raw[a:b]) for a, b in zip((new * u).tolist(), ((stop + view.length - 1) * u).tolist(), strict=True)], np.uint64)
                p = np.array(doc, np.int64)[piece[new]]
                yield pd.DataFrame({
                    "id": ids[p], "text_hash": hashes[p], "gram": (h[anchor[new]].view(np.int64) & ~1) | view.number, "digest": marks.view(np.int64),
                    "start": new - starts[piece[new]] + np.array(offset, np.int64)[piece[new]], "windows": stop - new, "lead": anchor[new] - new,
                })


def _blocks(texts: Iterator[np.ndarray], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Buffers of about BLOCK letters: whole texts, and overlapping pieces of long ones. With the document, place there and end in the buffer of each."""
    doc: list[int] = []
    offset: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, BLOCK):
            doc.append(k)
            offset.append(at)
            held.append(text[at : at + BLOCK + length - 1])
            size += len(held[-1])
            if size >= BLOCK // 2:
                yield doc, offset, np.cumsum([len(x) for x in held]), np.concatenate(held)
                doc, offset, held, size = [], [], [], 0
    if held:
        yield doc, offset, np.cumsum([len(x) for x in held]), np.concatenate(held)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (unsigned, most significant column first), and their longest common prefixes.

    Multikey quicksort, all groups at once: each group that is not sorted yet is split by a pivot word into less, equal and greater;
    the equal part goes on with the next word. lcp[i] is the number of equal words of places i - 1 and i (0 for i = 0)."""
    n, width = words.shape
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    starts, ends, depths = np.array([0]), np.array([n]), np.array([0])
    rng = np.random.default_rng(0)
    while len(starts):
        size = ends - starts
        done = (size <= 1) | (depths >= width)
        for a, b in zip(starts[(depths >= width) & (size > 1)], ends[(depths >= width) & (size > 1)], strict=True):
            lcp[a + 1 : b] = width
        starts, ends, depths, size = starts[~done], ends[~done], depths[~done], size[~done]
        if not len(starts):
            break
        group = np.repeat(np.arange(len(starts)), size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        value = words[order[place], np.repeat(depths, size)]
        three = np.sort(np.stack([words[order[starts + rng.integers(0, size)], depths] for _ in range(3)]), axis=0)
        pivot = three[1][group]
        side = (value > pivot).astype(np.int8) - (value < pivot).astype(np.int8)
        moved = np.lexsort((side, group))
        order[place] = order[place[moved]]
        less, equal = np.bincount(group[side < 0], minlength=len(starts)), np.bincount(group[side == 0], minlength=len(starts))
        one, two = starts + less, starts + less + equal
        # Neighbours in different parts first differ in this word.
        lcp[one[(less > 0)]] = depths[less > 0]
        lcp[two[two < ends]] = depths[two < ends]
        starts, ends, depths = np.concatenate([starts, one, two]), np.concatenate([one, two, ends]), np.concatenate([depths, depths + 1, depths])
    return order, lcp


def _ranked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text in their order, and common prefixes of neighbours in bytes. Texts count as ended by zeros."""
    width = -(-max(map(len, texts), default=1) // 8)
    data = np.frombuffer(b"".join(x.ljust(width * 8, b"\0") for x in texts), np.uint8).reshape(len(texts), width * 8)
    order, words = multikey_sort(data.view(">u8").astype(np.uint64)) if width else (np.arange(len(texts)), np.zeros(len(texts), np.int64))
    lcp = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        same = data[order[1:]] == data[order[:-1]]
        lcp[1:] = np.where(same.all(1), width * 8, same.argmin(1))
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    return rank, lcp


def repeated_windows(texts: list[bytes], lead: np.ndarray, windows: np.ndarray, length: int = LENGTH, unit: int = 1, owner: np.ndarray | None = None) -> np.ndarray:
    """Which windows (segment by segment, by start) also occur in a segment of another owner (by default, in any other segment).

    lead, windows and length count letters of ``unit`` bytes."""
    right_rank, right = _ranked([x[a * unit :] for x, a in zip(texts, lead, strict=True)])
    left_rank, left = _ranked([_reversed(x[: a * unit], unit) for x, a in zip(texts, lead, strict=True)])
    segment = np.repeat(np.arange(len(texts)), windows)
    owner = segment if owner is None else np.unique(owner, return_inverse=True)[1][segment]
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = lead[segment] - offset  # letters of a window before its anchor
    out = np.zeros(len(segment), bool)
    order = np.argsort(before, kind="stable")
    cuts = np.flatnonzero(np.diff(before[order], prepend=-1))
    for at in np.split(order, cuts[1:]):
        t, who = before[at[0]], segment[at]
        run = np.cumsum(right < (length - t) * unit)[right_rank[who]] * (len(texts) + 1) + np.cumsum(left < t * unit)[left_rank[who]]
        _, which = np.unique(run, return_inverse=True)
        least, most = np.full(len(which), len(texts)), np.full(len(which), -1)
        np.minimum.at(least, which, owner[at])
        np.maximum.at(most, which, owner[at])
        out[at] = (least < most)[which]
    return out


def _reversed(text: bytes, unit: int) -> bytes:
    return text[::-1] if unit == 1 else np.frombuffer(text, np.uint64)[::-1].tobytes()


def _runs(mask: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end (index into mask) of each run of true."""
    new = np.flatnonzero(mask & np.concatenate([[True], ~mask[:-1] | (owner[1:] != owner[:-1])]))
    end = np.flatnonzero(mask & np.concatenate([~mask[1:] | (owner[1:] != owner[:-1]), [True]])) + 1
    return owner[new], new, end


FOUND = "gram long, digest long, first int, last int, owner long, high long, low long"


def _bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows, and (with a digest) windows whose gram may go on in a neighbouring bucket."""
    held = [x for x in batches if len(x)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    for view in VIEWS:
        df = rows[(rows.gram & 1) == view.number]
        if len(df):
            yield from _searched(df, view)


def _searched(df: pd.DataFrame, view: View) -> Iterator[pd.DataFrame]:
    import xxhash

    texts = [bytes(x) for x in df.segment]
    lead, windows, gram, digest, owner = df.lead.to_numpy(np.int64), df.windows.to_numpy(np.int64), df.gram.to_numpy(), df.digest.to_numpy(), df.owner.to_numpy()
    repeated = repeated_windows(texts, lead, windows, view.length, view.unit, owner)
    segment = np.repeat(np.arange(len(df)), windows)
    base = np.cumsum(windows) - windows
    who, new, end = _runs(repeated, segment)
    yield pd.DataFrame({"gram": gram[who], "digest": digest[who], "first": new - base[who], "last": end - 1 - base[who], "owner": 0, "high": 0, "low": 0})
    heads = [x[a * view.unit : (a + view.gram) * view.unit] for x, a in zip(texts, lead, strict=True)]
    edge, split = {min(heads), max(heads)}, df.split.to_numpy()
    for k in [k for k, x in enumerate(heads) if split[k] and x in edge]:
        raw = memoryview(texts[k])
        marks = [xxhash.xxh3_128_intdigest(raw[i * view.unit : (i + view.length) * view.unit]) for i in range(windows[k])]
        at = np.arange(windows[k])
        yield pd.DataFrame({"gram": gram[k], "digest": digest[k], "first": at, "last": at, "owner": owner[k], "high": np.array([x >> 64 for x in marks], np.uint64).view(np.int64), "low": np.array([x & (1 << 64) - 1 for x in marks], np.uint64).view(np.int64)})


@F.pandas_udf(T.BinaryType())
def _pressed(text: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([press((x or "").encode("utf-8", "surrogatepass")) for x in text])


@F.pandas_udf(T.LongType())
def _text_hash(text: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series(np.array([xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass")) for x in text], np.uint64).view(np.int64))


def _cut_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in (df.iloc[k : k + SLICE] for df in batches for k in range(0, len(df), SLICE)):
        rows = []
        for text, wanted in zip(df.text, df.wanted, strict=True):
            data = zstandard.decompress(text)
            for view in VIEWS:
                mine = [r for r in wanted if r["gram"] & 1 == view.number]
                letters = view.letters(data) if mine else None
                rows += [(r["gram"], r["digest"], r["windows"], r["lead"], r["split"], r["owner"], letters[r["start"] : r["start"] + r["windows"] + view.length - 1].tobytes()) for r in mine]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPRESENTATIVES.split(", ")])


REPRESENTATIVES = "gram long, digest long, windows int, lead int, split boolean, owner long, segment binary"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in (df.iloc[k : k + SLICE] for df in batches for k in range(0, len(df), SLICE)):
        rows = []
        for id_, text, spans in zip(df.id, df.text, df.spans, strict=True):
            data, found = zstandard.decompress(text), [(int(x["view"]), int(x["a"]), int(x["b"])) for x in (spans if spans is not None else [])]
            removed, passages = (_merged([(a, b) for v, a, b in found if v == view.number]) for view in VIEWS)
            kept = [data[a:b] for a, b in zip([0] + [b for _, b in removed], [a for a, _ in removed] + [len(data)], strict=True)]
            rows.append((id_, len(data), sum(b - a for a, b in removed), len(removed), b"".join(kept), sum(b - a for a, b in passages)))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in CUT.split(", ")])
        out["id"] = out.id.astype("Int64")
        yield out


def find_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Spans (id, text_hash, view, a, b) of repeated windows of the documents, in bytes (view 0) or words (1), ready to be merged."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    segments = materialize(source.mapInPandas(_segments, SEGMENTS), "suffix-segments")
    key, words = ["gram", "digest"], F.col("gram").bitwiseAND(F.lit(1)) == 1
    document = F.xxhash64("id", "text_hash")
    #: Whether there is anything to repeat: another segment, or in passages one of another document.
    several = F.when(F.first(words), F.min(document) != F.max(document)).otherwise(F.count("*") > 1).alias("several")
    grams = segments.groupBy("gram").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("alike"), several).filter("several").drop("several")
    grams = materialize(grams, "suffix-grams")
    marked = materialize(join_hot(segments, grams, ["gram"], segments.count()).drop("n"), "suffix-marked")
    discard(segments, grams)
    whole = marked.filter("alike").drop("alike")
    open_ = marked.filter("not alike").drop("alike")
    kinds = materialize(open_.groupBy(*key).agg(F.count("*").alias("n"), several, F.min_by(F.struct("id", "text_hash", "start", "windows", "lead"), F.struct("id", "text_hash", "start")).alias("at")), "suffix-kinds")
    n_kinds, n_open = kinds.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    large = kinds.groupBy("gram").agg(F.count("*").alias("reps")).filter(F.col("reps") > BUCKET_ROWS).select("gram", F.lit(True).alias("split"))
    # A segment that occurs twice is repeated as a whole, but its windows still count for others. One of a single document is owned by it.
    owner = F.when(words & ~F.col("several"), F.xxhash64("at.id", "at.text_hash")).otherwise(F.xxhash64(*key, F.lit("several"))).alias("owner")
    wanted = kinds.join(F.broadcast(large), "gram", "left").select("at.id", "at.text_hash", F.struct("gram", "digest", "at.start", "at.windows", "at.lead", F.coalesce("split", F.lit(False)).alias("split"), owner).alias("w")).groupBy("id", "text_hash").agg(F.collect_list("w").alias("wanted"))
    texts = source.filter(F.octet_length("text") >= SHORTEST).select("id", _text_hash("text").alias("text_hash"), _pressed("text").alias("text"))
    found = texts.join(wanted, (texts.id.eqNullSafe(wanted.id)) & (texts.text_hash == wanted.text_hash)).select("text", "wanted")
    representatives = materialize(found.mapInPandas(_cut_segments, REPRESENTATIVES), "suffix-representatives")
    n = max(n_partitions(spark), -(-n_kinds // BUCKET_ROWS))
    # Sampled splitters; only large grams may be split, by digest, see _searched.
    unit, gram = F.when(words, WORDS.unit).otherwise(BYTES.unit), F.when(words, WORDS.gram).otherwise(BYTES.gram)
    ranged = representatives.repartitionByRange(n, words, F.substring("segment", F.col("lead") * unit + 1, gram * unit), F.when(F.col("split"), F.col("digest")).otherwise(F.lit(0)))
    results = materialize(ranged.mapInPandas(_bucket, FOUND), "suffix-found")
    discard(representatives)
    edges = results.filter((F.col("high") != 0) | (F.col("low") != 0))
    shared = edges.groupBy("high", "low").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least <> most").select("high", "low")
    across = edges.join(shared, ["high", "low"]).select(*key, "first", "last")
    runs = results.filter("high = 0 and low = 0").select(*key, "first", "last").unionAll(across)
    # What is repeated of each kind of segment: all windows, or runs of them (no more than a segment has windows).
    runs = runs.groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    judged = materialize(kinds.select(*key, "n", "several").join(runs, key, "left").filter("several or runs is not null"), "suffix-judged")
    discard(kinds, results)
    everything = F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    partly = join_hot(open_, judged, key, n_open).withColumn("runs", F.when(F.col("several"), everything).otherwise(F.col("runs")))
    hits = whole.withColumn("runs", everything).select("id", "text_hash", "gram", "start", "runs").unionByName(partly.select("id", "text_hash", "gram", "start", "runs"))
    length = F.when(words, WORDS.length).otherwise(BYTES.length)
    return hits.select("id", "text_hash", "gram", "start", F.explode("runs").alias("r")).select(
        "id", "text_hash", words.cast("int").alias("view"), (F.col("start") + F.col("r.first")).alias("a"), (F.col("start") + F.col("r.last") + length).alias("b")
    )


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes that are left) and n_passage_words.

    n_passage_words: words in passages of over 50 words that another document has too, whatever their bytes; nothing is cut for them."""
    spans = find_repeats(docs, text_col, id_col).groupBy("id", "text_hash").agg(F.collect_set(F.struct("view", "a", "b")).alias("spans"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(F.col(text_col)).alias("text_hash"), _pressed(F.col(text_col)).alias("text"))
    joined = texts.join(spans, (texts.id.eqNullSafe(spans.id)) & (texts.text_hash == spans.text_hash), "left").select(texts.id, "text", "spans")
    return joined.mapInPandas(_cut, CUT).withColumnRenamed("id", id_col)


#: The same by brute force in SQL: all windows by their digests. Hexadecimal digits stand for bytes; texts are cut into pieces first, as a digit's place in a long string is slow to find.
SQL = r"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
pieces as (select doc_id, n, a, substr(x, 2 * a + 1, 2 * 1199) as piece from (select doc_id, n, x, unnest(range(0, n - 399, 800)) as a from texts)),
windows as (select doc_id, a + k as i, md5_number(substr(piece, 2 * k + 1, 800)) as h from (select *, unnest(range(0, least(800, n - 399 - a))) as k from pieces)),
starts as (select doc_id, i from windows where h in (select h from windows group by h having count(*) > 1)),
islands as (select doc_id, i, sum(new) over (partition by doc_id order by i) as island from (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 400 then 1 else 0 end as new from starts)),
spans as (select doc_id, min(i) as a, max(i) + 400 as b from islands group by doc_id, island),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cut as (select g.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from gaps g join texts using (doc_id) group by g.doc_id),
word_windows as (select doc_id, j, md5_number(array_to_string(words[j + 1 : j + 51], ' ')) as h from (select doc_id, words, unnest(range(0, len(words) - 50)) as j from texts)),
word_starts as (select doc_id, j from word_windows where h in (select h from word_windows group by h having count(distinct doc_id) > 1)),
passages as (select doc_id, sum(least(51, coalesce(after - j, 51)))::bigint as n_passage_words from (select doc_id, j, lead(j) over (partition by doc_id order by j) as after from word_starts) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256, coalesce(n_passage_words, 0) as n_passage_words
from texts left join cut using (doc_id) left join passages using (doc_id)
"""
