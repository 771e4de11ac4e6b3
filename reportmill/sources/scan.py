"""Rows of XML files that end at the closing tags of an element, found by state and not by text alone.

A file is read as text that Spark splits. Its rows end before ``</tag``; where that text lies in a comment, a character data section or an
instruction, or begins a longer name, it is no boundary. Whether it does depends on the state in which the row begins, so of every row
it is worked out in what state it ends for each state it may begin in. These transitions compose: rows to blocks of a file, blocks to
files. With the state in which its block begins, a task then walks over the rows once more and joins those that begin within something to the row before.

Most files have no such row. A first pass over the text finds those that do, and those in other encodings than UTF-8; only they take the longer way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.functions.scalars import in_order

#: What begins and ends a stretch in which tags do not count. The states are text (0) and, from 1 on, these.
STRETCHES = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))
SECTION = 2
_OPENERS = r"<!--|<!\[CDATA\[|<\?"
_CUTS = rf"(?={_OPENERS})|(?<=-->)|(?<=\]\]>)|(?<=\?>)"
#: Encodings of which each byte below 128 is its ASCII character, so that tags can be found before the text is decoded.
BYTEWISE = ("US-ASCII", "ASCII", "ISO-8859-1", "LATIN1", "LATIN-1")
#: Files that are named in a filter at most; where more need the longer way, all files take it.
NAMED = 1000


def marked(value: Column) -> Column:
    """Whether a text has the beginning of a stretch, which is to be read as :func:`plain`."""
    return value.rlike(_OPENERS)


def _parts(value: Column) -> Column:
    """A text cut before every beginning of a stretch and after every end."""
    return F.split(value, _CUTS)


def _whole(part: Column, k: int) -> Column:
    """Whether a part is a stretch of the kind k from its beginning to its end."""
    open_, close = STRETCHES[k - 1]
    return part.startswith(open_) & part.endswith(close) & (F.length(part) >= len(open_) + len(close))


def _next(state: Column, part: Column) -> Column:
    """The state after a part that begins in ``state``."""
    kinds = range(len(STRETCHES), 0, -1)
    begun = reduce(lambda other, k: F.when(part.startswith(STRETCHES[k - 1][0]), F.when(_whole(part, k), 0).otherwise(k)).otherwise(other), kinds, F.lit(0))
    within = reduce(lambda other, k: F.when((state == k) & part.endswith(STRETCHES[k - 1][1]), 0).otherwise(other), kinds, state)
    return F.when(state == 0, begun).otherwise(within)


def _settled(parts: Column) -> Column:
    """Whether all parts begin outside of stretches, if the first does."""
    return F.forall(parts, lambda part: reduce(lambda a, b: a & b, [~part.startswith(STRETCHES[k - 1][0]) | _whole(part, k) for k in range(1, len(STRETCHES) + 1)]))


def after(value: Column, state: int = 0) -> Column:
    """The state in which a text ends that begins in ``state``."""
    found = F.aggregate(_parts(value), F.lit(state), _next)
    return found if state else F.when(_settled(_parts(value)), 0).otherwise(found)


def _quoted(x: str) -> str:
    return re.sub(r"([\[\]?])", r"\\\1", x)


#: A stretch up to its end or the text's.
_STRETCH = "|".join(rf"{_quoted(o)}.*?(?:{_quoted(c)}|\z)" for o, c in STRETCHES)


def _said(part: Column) -> Column:
    """What a part says: sections escaped, comments and instructions left out."""
    open_, close = STRETCHES[SECTION - 1]
    inner = F.substr(part, F.lit(len(open_) + 1))
    inner = F.when(inner.endswith(close), F.left(inner, F.length(inner) - len(close))).otherwise(inner)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        inner = F.replace(inner, F.lit(raw), F.lit(safe))
    dropped = reduce(lambda a, b: a | b, [part.startswith(o) for k, (o, _) in enumerate(STRETCHES, 1) if k != SECTION])
    return F.when(part.startswith(open_), inner).when(dropped, "").otherwise(part)


def plain(value: Column) -> Column:
    """A text that begins outside of all stretches without its comments and instructions; character data sections become escaped text.

    It is cut to whole stretches and what lies between them, so its cost is in proportion to its length, whatever sections hold."""
    parts = F.regexp_extract_all(value, F.lit(f"(?s){_STRETCH}|<[^<]*+|[^<]++"), F.lit(0))
    return F.array_join(F.transform(parts, _said), "")


def _lines(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """file_id, block, id, parted (whether the file has other blocks), value: text up to the next ``</tag``, wherever that stands."""
    rows = spark.read.option("lineSep", f"</{tag}").text(path)
    parted = F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), parted.alias("parted"), "value")


def _tag_ends(value: Column) -> Column:
    return value.rlike(r"^\s*>")


_OPENING = re.compile("|".join(re.escape(o) for o, _ in STRETCHES).encode())
_KINDS = {o.encode(): k for k, (o, _) in enumerate(STRETCHES, 1)}
_CLOSINGS = [c.encode() for _, c in STRETCHES]
_HEAD = re.compile(rb"\s*>")


def walked(text: bytes, state: int) -> int:
    """:func:`after` in Python."""
    at = 0
    while True:
        if not state:
            found = _OPENING.search(text, at)
            if not found:
                return 0
            state, at = _KINDS[found.group()], found.end()
        close = _CLOSINGS[state - 1]
        at = text.find(close, at)
        if at < 0:
            return state
        state, at = 0, at + len(close)


@F.pandas_udf(T.BooleanType())
def _open_at_end(text: pd.Series) -> pd.Series:
    """Whether a text in bytes that begins outside of stretches ends within one."""
    return pd.Series([walked(x, 0) != 0 for x in text], dtype=bool)


def unusual(lines: DataFrame) -> list[tuple[str, str | None]]:
    """Files that need the longer way, with their encoding if it is not UTF-8.

    Usual ones have rows that all end outside of stretches, and all but the first begin with the end of a tag."""
    head = F.when(F.col("block") == 0, F.left("value", F.lit(200)))
    said = F.upper(F.nullif(F.regexp_extract(head, r"""^\uFEFF?\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.:-]+)["']""", 1), F.lit("")))
    wide = F.when(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF") & (F.col("block") == 0), "UTF-16")
    # Rows without any mark, behind a tag's end, say nothing; they are most rows of most files.
    telling = lines.filter(marked(F.col("value")) | ~_tag_ends(F.col("value")) | (F.col("block") == 0)).withColumn("inside", _open_at_end(F.col("value").cast("binary")))
    inside = F.col("inside")
    found = telling.groupBy("file_id").agg(F.count_if(inside | ~_tag_ends(F.col("value"))).alias("n"), F.bool_or(inside).alias("inside"), F.coalesce(F.max(wide), F.max(said)).alias("encoding"))
    other = F.when(~F.col("encoding").isin("UTF-8", "UTF8"), F.col("encoding"))
    # The first row of a file does not begin with the end of a tag.
    rows = found.filter(F.expr("n > 1 or inside") | other.isNotNull()).select("file_id", other.alias("encoding"))
    return [(r.file_id, r.encoding) for r in rows.toLocalIterator()]


def _transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The transition of each block. All rows of a block are in one task, in order."""
    key, states = None, []
    for df in batches:
        done = []
        for file, block, text in zip(df.file_id, df.block, df.value, strict=True):
            if (file, block) != key:
                if key:
                    done.append((*key, states))
                key, states = (file, block), list(range(len(STRETCHES) + 1))
            ends = {k: walked(text, k) for k in set(states)}
            states = [ends[k] for k in states]
        yield pd.DataFrame(done, columns=["file_id", "block", "t"])
    if key:
        yield pd.DataFrame([(*key, states)], columns=["file_id", "block", "t"])


def _starts(df: pd.DataFrame) -> pd.DataFrame:
    """Of a file's blocks, the state in which each begins."""
    df, state, out = df.sort_values("block"), 0, []
    for t in df.t:
        out.append(state)
        state = int(t[state])
    return pd.DataFrame({"file_id": df.file_id, "block": df.block, "state": out})


def _runs(tag: str):
    columns, between = ["file_id", "block", "id", "parted", "head", "edge", "value"], f"</{tag}".encode()

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block joined up to each boundary. head: whether one begins at a boundary; edge: whether it may go on in another block."""
        key, state, held, first = None, 0, [], None
        for df in batches:
            done = []
            for file, block, number, parted, start, text in zip(df.file_id, df.block, df.id, df.parted, df.state, df.value, strict=True):
                new = (file, block) != key
                if new:
                    state = start
                head = state == 0 and bool(_HEAD.match(text))
                if new or head:
                    if held:
                        done.append((*first, first[3] and (new or not first[4]), between.join(held)))
                    key, held, first = (file, block), [], (file, block, number, parted, head or (new and block == 0))
                held.append(text)
                state = walked(text, state)
            yield pd.DataFrame(done, columns=columns)
        if held:
            yield pd.DataFrame([(*first, first[3], between.join(held))], columns=columns)

    return runs


def joined(lines: DataFrame, tag: str) -> DataFrame:
    """file_id, place, parted, value: rows that begin and end outside of all stretches, each at a closing tag.

    A task has the rows of its blocks in order, so it joins them where they are. Only what reaches over the end of a block, one row at most for
    each, is shuffled. The states in which blocks begin are broadcast: one row for each block, of which Spark's driver has a list anyway."""
    rows = lines.select("file_id", "block", "id", "parted", F.col("value").cast("binary").alias("value"))
    blocks = rows.mapInPandas(_transitions, "file_id string, block long, t array<int>")
    starts = F.broadcast(blocks.groupBy("file_id").applyInPandas(_starts, "file_id string, block long, state int"))
    runs, schema = _runs(tag), "file_id string, block long, id long, parted boolean, head boolean, edge boolean, value binary"

    def found(rows: DataFrame) -> DataFrame:
        placed = rows.join(starts, ["file_id", "block"]).select("file_id", "block", "id", "parted", "state", "value").mapInPandas(runs, schema)
        return placed.select("file_id", F.struct("block", "id").alias("place"), "parted", "head", "edge", F.col("value").cast("string").alias("value"))

    columns = ["file_id", "place", "parted", "value"]
    upto = Window.partitionBy("file_id").orderBy("place")
    edges = found(rows.filter("parted")).filter("edge").withColumn("run", F.sum(F.col("head").cast("int")).over(upto))
    whole = edges.groupBy("file_id", "run").agg(F.min("place").alias("place"), F.lit(True).alias("parted"), F.array_join(in_order(F.col("value"), F.col("place")), f"</{tag}").alias("value"))
    return found(rows).filter("not edge").select(*columns).unionByName(whole.select(*columns))


def decoded(spark: SparkSession, path: str | list[str], lines: DataFrame, files: list[tuple[str, str]], tag: str) -> DataFrame:
    """The rows of files in other encodings, as :func:`_lines`. Where a tag cannot be found in the bytes, a task reads a whole file."""
    out = []
    for encoding in sorted({e for _, e in files}):
        names = [f for f, e in files if e == encoding]
        if encoding in BYTEWISE:
            name = "ISO-8859-1" if "1" in encoding else "US-ASCII"
            out.append(lines.filter(F.col("file_id").isin(names)).withColumn("value", F.decode(F.col("value").cast("binary"), name)))
        elif encoding.startswith("UTF-16"):
            whole = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_id"), F.decode("content", encoding).alias("x")).filter(F.col("file_id").isin(names))
            cut = whole.select("file_id", F.lit(0).cast("long").alias("block"), F.lit(False).alias("parted"), F.posexplode(F.split("x", f"</{tag}")).alias("id", "value"))
            out.append(cut.withColumn("id", F.col("id").cast("long")))
        else:
            raise ValueError(f"{', '.join(names[:3])}: the encoding {encoding} is not supported")
    return reduce(DataFrame.unionByName, out)


def rows(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """file_id, place (block, id), parted, value: rows of all files that begin and end outside of comments, sections and instructions, each but the last of
    a file before a closing tag of ``tag``. Looks over the files once."""
    lines = _lines(spark, path, tag)
    other = unusual(lines)
    usual = lines.select("file_id", F.struct("block", "id").alias("place"), "parted", "value")
    if not other:
        return usual
    foreign = [(f, e) for f, e in other if e]
    names = [f for f, _ in other] if len(other) <= NAMED else None
    kept = lines.filter(F.col("file_id").isin(names)) if names else lines
    if foreign:
        kept = kept.filter(~F.col("file_id").isin([f for f, _ in foreign])).unionByName(decoded(spark, path, lines, foreign, tag))
    return usual.filter(~F.col("file_id").isin(names)).unionByName(joined(kept, tag)) if names else joined(kept, tag)
