"""WARC: archives written and read through Spark, and an external merge of their capture index.

Writing: each page becomes one WARC record. The record is text (headers, then the page in UTF-8) and ends in two
line breaks, which is the line separator given to Spark's text writer; so archives are plain gzipped WARC
files in whatever store Spark writes to. Records are dealt to archives by classes of size, so that an archive holds about
``ARCHIVE_BYTES`` at most. Reading: each archive is inflated piece by piece and parsed by the records' content lengths, never by their separators.

Index: the captures of an archive, sorted by (URL key, timestamp, id), are one run. Runs are cut by sampled splitters into
key ranges. A range's task gets its slices of the k runs one after the other (Spark sorts them by run, spilling to disk), keeps them in a
file and merges them with a loser tree that holds one block of each slice in memory. Ranges in order hold the globally ordered capture
histories. Splitters are whole keys, so one host's captures spread over ranges.

Defined results: null html is an empty payload; a null url becomes ``urn:page:<id>``; white space and control characters
in urls are percent-encoded; null ids are written as ``null``, read as null and always responses; of rows with equal payloads those with the smallest id
are responses, the others revisit it; repeated rows with one id are alike; captures that are equal in URL key, timestamp and id keep the order of their
archives; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import tempfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.llm.common import discard, join_hot, materialize, n_partitions, scratch_path

#: Bytes of an archive's records before compression, about, and records of it at most.
ARCHIVE_BYTES, RECORDS_PER_FILE = 256 << 20, 5000
#: Records of a class are this long at most; the last class has no bound, and its archives hold few.
CLASSES = (48 << 10, 1 << 20, 16 << 20)
#: Captures that one range of the merge holds, about; captures of a slice that are in memory at once; compressed bytes that are inflated at once.
RANGE_ROWS, BLOCK_ROWS, PIECE = 100_000, 512, 1 << 20
#: Seconds since 1970 of the first capture; page ids count on from there where no timestamp is given.
FIRST_CAPTURE = 1_577_836_800


def decide_records(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """id, digest, first: the pages that revisit the payload of page ``first``. Only digests and ids are shuffled; frequent digests are not."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    digests = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.length(payload).alias("bytes")).filter(F.col("id").isNotNull() & (F.col("bytes") >= min_bytes))
    digests = materialize(digests.select("id", "digest"), "warc-digests")
    shared = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter(F.col("first") != F.col("last")).drop("last")
    return join_hot(digests, materialize(shared, "warc-shared"), ["digest"], digests.count()).filter(F.col("id") != F.col("first")).select("id", "digest", "first").distinct()


def write_warc(pages: DataFrame, path: str, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_bytes: int = 0) -> None:
    """One record for each page, response or revisit, into gzipped archives in the folders of ``path``, one for each class of sizes that occurs."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.col(url_col).alias("url"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    revisits = materialize(decide_records(pages, html_col, id_col, min_bytes), "warc-revisits")
    joined = rows.join(revisits, ["id", "digest"], "left")  # small beside the pages; Spark broadcasts it where its size allows
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), name))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.lit(2**31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("html"))).otherwise(http)
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("first").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("first").isNotNull(), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"))
    length = F.octet_length("html")
    most = rows.agg(F.max(length)).first()[0] or 0
    for k, (low, high) in enumerate(zip((-1, *CLASSES), (*CLASSES, 1 << 62), strict=True)):
        if k == 0 or most > low:  # each class is a pass over the pages; most corpora need one
            mine = joined if most <= high and k == 0 else joined.filter((length > low) & (length <= high))
            per_file = max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES // min(high, ARCHIVE_BYTES)))
            mine.withColumn("block", block).select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/class={k}")


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else url.lower()


def base32_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Inflated:
    """The bytes of a gzipped archive (of one member or of many), read from the front with one piece in memory."""

    def __init__(self, content: bytes):
        self.content, self.next, self.at = memoryview(content), 0, 0
        self.inflate, self.held = zlib.decompressobj(47), bytearray()

    def more(self) -> bool:
        if self.inflate.eof:
            rest = len(self.inflate.unused_data)
            self.next, self.inflate = self.next - rest, zlib.decompressobj(47)
        if self.next >= len(self.content):
            return False
        piece = self.content[self.next : self.next + PIECE]
        self.next += len(piece)
        self.held += self.inflate.decompress(piece)
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError(f"the archive ends at byte {self.at + len(self.held)}, within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is skipped; None at the end of the archive."""
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError(f"no record at byte {self.at}")
                return None
        out = self.take(k)
        self.take(len(mark))
        return out


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length of each record of a gzipped archive."""
    archive, gap = Inflated(content), b"\r\n\r\n"
    while True:
        at = archive.at
        if (head := archive.until(gap)) is None:
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = archive.take(int(headers["Content-Length"]))
        http, _, payload = block.partition(gap)
        headers["payload-bytes"] = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:])["Content-Length"]
        if archive.take(4) != gap:
            raise ValueError(f"the record at byte {at} has no end")
        yield headers, payload, at, archive.at - at


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix("urn:page:")
    return None if number == "null" else int(number)


CAPTURE = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, archives being runs: sorted by (url_key, ts, page_id), numbered by ``seq``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for file, content in zip(df.path, df.content, strict=True):
                rows = []
                for head, payload, at, length in parse_records(content):
                    kind = head["WARC-Type"]
                    said = bytes.fromhex(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if kind == "response" and hashlib.sha1(payload).digest() != said:
                        raise ValueError(f"{file}: the record at byte {at} is damaged")
                    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, refers, int(head["payload-bytes"]), base64.b32encode(said).decode(), file, at, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in CAPTURE.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                out["seq"] = range(len(out))
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, CAPTURE + ", seq long")


class LoserTree:
    """Merges k sorted iterators: inner nodes hold losers, so each step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs come last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x < y or (x == y and a < b))) if x is not None or y is None else False

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[run := self.losers[0]]) is not None:
            yield head
            self.heads[run] = next(self.runs[run], None)
            self._replay(run)


def merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Captures by archive and place in it, merged to one order. What is in memory is a block of each archive's slice; the rest is in a file of the task."""
    with tempfile.TemporaryFile() as spool:  # without a name: gone with the task
        runs: dict[str, list[tuple[int, int]]] = {}
        for df in batches:
            for file, part in df.groupby("file", sort=False):
                for k in range(0, len(part), BLOCK_ROWS):
                    data = pickle.dumps(part.iloc[k : k + BLOCK_ROWS], pickle.HIGHEST_PROTOCOL)
                    runs.setdefault(file, []).append((spool.tell(), len(data)))
                    spool.write(data)

        def slices(blocks: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in blocks:
                spool.seek(at)
                df = pickle.loads(spool.read(size))
                ids = [None if pd.isna(x) else int(x) for x in df.page_id]
                keys = zip(df.url_key, df.ts, [x is None for x in ids], [x or 0 for x in ids], strict=True)
                yield from ((key, _Row(row)) for key, row in zip(keys, df.itertuples(index=False, name=None), strict=True))

        columns, place, held = [x.split()[0] for x in (CAPTURE + ", seq long").split(", ")], 0, []

        def out() -> pd.DataFrame:
            df = pd.DataFrame(held, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
            return df.assign(place=range(place - len(held), place))

        for _, row in LoserTree([slices(runs[f]) for f in sorted(runs)]):
            held.append(row.values)
            place += 1
            if len(held) >= 10 * BLOCK_ROWS:
                yield out()
                held = []
        if held:
            yield out()


class _Row:
    """A row that takes no part in comparisons: rows of equal keys keep the order of their runs."""

    def __init__(self, values: tuple):
        self.values = values

    def __lt__(self, other: _Row) -> bool:
        return False

    def __eq__(self, other: object) -> bool:
        return True

    __hash__ = None


def merge_index(captures: DataFrame, rows: int) -> DataFrame:
    """The captures with ``position``, their place in the global order from 0.

    captures: as read_warc gives them, written to a table; rows: how many there are, about."""
    spark = captures.sparkSession
    n = max(n_partitions(spark), -(-rows // RANGE_ROWS))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for df in merge_runs(batches):
            yield df.assign(range=TaskContext.get().partitionId())

    # Ranges by key; within one, the slices of the runs as they were written.
    ranged = captures.repartitionByRange(n, "url_key", "ts", F.col("page_id").asc_nulls_last(), "file", "seq").sortWithinPartitions("file", "seq")
    merged = materialize(ranged.mapInPandas(merge, CAPTURE + ", seq long, place long, range int"), "warc-merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "range").withColumn("position", F.col("start") + F.col("place")).drop("range", "start", "place")


def capture_histories(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages as WARC, read the archives back and merge their index. One row for each record, see CAPTURE."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, html_col, id_col, url_col, min_bytes)
    captures = materialize(read_warc(spark, path), "warc-captures")
    merged = merge_index(captures, captures.count())
    discard(captures)
    return merged


def history_number(index: DataFrame) -> DataFrame:
    """Adds ``capture``: the place of a capture in its URL key's history, from 1."""
    return index.withColumn("capture", F.row_number().over(Window.partitionBy("url_key").orderBy("position")))


#: Records, digests and the global order of captures in SQL.
SQL = r"""
with payloads as (
  select page_id, url, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
decided as (select *, min(page_id) over (partition by digest) as first from payloads),
named as (
  select *, lower(coalesce(regexp_replace(url, '[\x00-\x20\x7f]', '%20', 'g'), 'urn:page:' || page_id)) as u,
    strftime(make_timestamp((1577836800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as ts
  from decided),
parts as (
  select *, regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) as host,
    regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) as asked
  from named),
keyed as (
  select *, case when host = '' then u else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else path end
    || case when asked = '' then '' else '?' || asked end end as url_key
  from parts),
-- Five hexadecimal digits are four digits of base 32.
digits as (select page_id, k, list_sum(list_transform(range(5), lambda i: (instr('0123456789abcdef', substr(digest, 5 * k + i + 1, 1)) - 1) * (16 ** (4 - i))))::bigint as v from (select page_id, digest, unnest(range(8)) as k from payloads)),
encoded as (
  select page_id, string_agg(array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), ''), '' order by k) as payload_digest
  from digits group by page_id)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, row_number() over (order by url_key, ts, page_id) - 1 as position
from keyed join encoded using (page_id)
"""
