"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is encoded as the sequence of pieces with the largest sum of log scores. White space becomes the marker U+2581, one is put before
the text, characters without a piece fall back to byte pieces. Inside, the marker is the byte 0xFF, which no UTF-8 text holds; so
a literal U+2581 falls back to bytes and every text decodes to itself.

No piece has the marker behind another character, so a text falls into units (markers and what follows them) that are
encoded independently, each distinct unit of a block once. All units of a block advance together: the trie is walked from every
character at once, then the Viterbi recursion takes one position of all units in each step.

The vocabulary is a SentencePiece model file (never trained here); its path is a parameter. Unigram models bring log scores. Of
BPE models the scores are merge ranks; they become log probabilities by Zipf's law, log(1 / ((rank + 1) * H)).

Defined results: null text gives null pieces; an empty text no pieces; ties go to the longer last piece; repeated rows are encoded alike;
extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER, MARK = "▁", 0xFF
#: As in SentencePiece: an unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Characters of text encoded together; units that a worker remembers.
BLOCK, POOL = 1 << 20, 200_000
#: Units whose arrays are worked on at once; they then fit into a processor's cache.
STEP = 8000


@dataclass
class Vocabulary:
    """pieces: bytes of each id, with MARK for the marker (empty for control pieces); scores; byte_ids: the piece of each byte."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray  # ids that may match text

    def __post_init__(self) -> None:
        self.pool = Pool()
        self.unknown = float(self.scores[self.normal].min()) - UNKNOWN_PENALTY
        self.base, self.check, self.value = build_trie({self.pieces[i]: int(i) for i in self.normal})
        matched = [self.pieces[i] for i in self.normal]
        self.longest = max(map(len, matched))
        mark = bytes([MARK])
        self.splits = not any(mark in p.lstrip(mark) for p in matched)
        lines = not any(b"\n" in p for p in matched)  # then a line break is a unit of its own
        rest = rb"[^\xff\n]" if lines else rb"[^\xff]"
        self.units = re.compile((rb"\n|" if lines else b"") + rb"\xff+" + rest + rb"*|" + rest + rb"+") if self.splits else re.compile(rb"(?s).+")
        self.out = [p.replace(mark, b" ") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.out[i] = bytes([b])
        # The same one after the other, for texts of many pieces.
        self.flat, self.widths = np.frombuffer(b"".join(self.out), np.uint8), np.array([len(p) for p in self.out], np.int64)
        self.places = np.cumsum(self.widths) - self.widths


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    is_byte = np.array([sp.is_byte(i) for i in range(n)])
    normal = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
    pieces = [sp.id_to_piece(i).encode().replace(MARKER.encode(), bytes([MARK])) if not (is_byte[i] or sp.is_control(i) or sp.is_unknown(i)) else b"" for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    ranks = -scores[normal]
    if (ranks == np.round(ranks)).all() and ranks.min() >= 0:  # merge ranks
        scores[normal] = -np.log(ranks + 1) - np.log((1 / (ranks + 1)).sum())
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not is_byte[byte_ids].all():
        raise ValueError("the model has no byte pieces")
    return Vocabulary(pieces, scores, byte_ids, normal)


def build_trie(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array: from state s, byte c leads to t = base[s] + c if check[t] == s. value[t]: the word that ends there, or -1. Root: 0."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, value in words.items():
        at = 0
        for c in word:
            at = children[at].setdefault(c, len(children))
            if at == len(children):
                children.append({})
                ends.append(-1)
        ends[at] = value
    size = 2 * len(children) + 512
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    state, first, top = [0] * len(children), 257, 257  # bases are positive, so low places would never fit
    for node, below in enumerate(children):  # parents come before their children
        if not below:
            continue
        codes = np.array(sorted(below))
        while used[first]:
            first += 1
        # One child fits the first free place; more are tried near the end, and single ones fill the gaps later.
        start = max(1, (first if len(codes) == 1 else max(first, top - 512)) - int(codes[0]))
        while True:
            if start + 1024 >= size:
                base, check, value, used = (np.concatenate([x, np.full(size, y, x.dtype)]) for x, y in ((base, 0), (check, -1), (value, -1), (used, False)))
                size *= 2
            tried = np.arange(start, start + 256)
            free = tried[~used[tried[:, None] + codes].any(1)]
            if len(free):
                start = int(free[0])
                break
            start += 256
        top = max(top, start + int(codes[-1]))
        base[state[node]] = start
        for c in codes.tolist():
            t = start + c
            used[t], check[t], value[t], state[below[c]] = True, state[node], ends[below[c]], t
    return base, check, value


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all elements of slices, one slice after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def encode_units(units: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units, and how many each has."""
    v = vocabulary
    lengths = np.array([len(u) for u in units], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.frombuffer(b"".join(units), np.uint8).astype(np.int64)
    n = len(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # every character's first byte
    width = np.diff(np.append(lead, n))
    limit = np.repeat(ends, lengths)[lead]
    # Walk the trie from every character at once.
    at, state, origin = lead.copy(), np.zeros(len(lead), np.int64), np.arange(len(lead))
    found = []
    for _ in range(v.longest):
        go = at < limit[origin]
        at, state, origin = at[go], state[go], origin[go]
        t = v.base[state] + data[at]
        t = np.where((t < len(v.check)) & (v.base[state] > 0), t, 0)
        go = v.check[t] == np.where(t > 0, state, -2)
        at, state, origin = at[go] + 1, t[go].astype(np.int64), origin[go]
        hit = v.value[state] >= 0
        found.append((origin[hit], at[hit], v.value[state[hit]].astype(np.int64)))
    origin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    single = np.zeros(len(lead), bool)
    single[origin[end - lead[origin] == width[origin]]] = True
    alone = np.flatnonzero(~single)  # fall back to bytes
    origin, end, piece = np.concatenate([origin, alone]), np.concatenate([end, lead[alone] + width[alone]]), np.concatenate([piece, np.full(len(alone), -1)])
    score = np.where(piece >= 0, v.scores[piece], v.unknown)
    begin = lead[origin]
    step = begin - np.repeat(starts, lengths)[begin]
    order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")  # short keys sort by radix
    begin, end, piece, score, step = begin[order], end[order], piece[order], score[order], step[order]
    # Position n + unit stands for each unit's end, as the next unit's start has the same place in the data.
    unit = np.repeat(np.arange(len(units)), lengths)[begin]
    goal = np.where(end == ends[unit], n + unit, end)
    best, back = np.full(n + len(units), -np.inf), np.full(n + len(units), -1)
    best[starts] = 0
    cuts = np.searchsorted(step, np.arange(int(step.max(initial=-1)) + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        candidate = best[begin[a:b]] + score[a:b]
        better = np.flatnonzero(candidate > best[goal[a:b]])  # arcs of one step have different goals
        best[goal[a + better]] = candidate[better]
        back[goal[a + better]] = a + better
    # From the ends back to the starts, all units at once.
    owner, place, path = np.arange(len(units)), n + np.arange(len(units)), []
    while len(owner):
        arc = back[place]
        path.append((owner, arc))
        more = begin[arc] > starts[owner]
        owner, place = owner[more], begin[arc[more]]
    who, arc = (np.concatenate(x) for x in zip(*path, strict=True)) if path else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(begin[arc])  # units lie one after the other
    who, arc = who[order], arc[order]
    size = np.where(piece[arc] >= 0, 1, end[arc] - begin[arc])
    ids = np.repeat(piece[arc], size)
    raw = ids < 0
    ids[raw] = v.byte_ids[data[_ragged(begin[arc], size)[raw]]]
    return ids, np.bincount(who, size, len(units)).astype(np.int64)


class Pool:
    """Pieces of units met so far, so that frequent units are encoded once; at most about POOL units.

    Keys are units without their first marker; a unit that has none is marked by the byte 0xFE, which no text holds either."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str, vocabulary: Vocabulary) -> list[int]:
        data, known, mark = text.encode("utf-8", "surrogatepass"), self.known, b" "
        if vocabulary.splits and b"  " not in data and data[:1] != mark and data[-1:] != mark:
            return [known.setdefault(u, len(known)) for u in data.split(mark)]
        units = vocabulary.units.findall(b"\xff" + data.replace(mark, b"\xff"))
        return [known.setdefault(u[1:] if u[0] == MARK else b"\xfe" + u, len(known)) for u in units]

    def complete(self, vocabulary: Vocabulary) -> None:
        new = list(islice(self.known, len(self.sizes), None))
        if new:
            units = [u[1:] if u[:1] == b"\xfe" else b"\xff" + u for u in new]
            ids, sizes = (np.concatenate(x) for x in zip(*[encode_units(units[k : k + STEP], vocabulary) for k in range(0, len(units), STEP)], strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes])


def encode(texts: list[str | None], vocabulary: Vocabulary) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    block: list[list[int] | None] = []
    size = 0
    pool = vocabulary.pool

    def flush() -> None:
        pool.complete(vocabulary)
        at = np.fromiter(chain.from_iterable(x for x in block if x), np.int64)
        sizes = pool.sizes[at]
        ids = pool.ids[_ragged(pool.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x or ()) for x in block])] if block else []
        start = 0
        for used, end in zip(block, ends, strict=True):
            out.append(None if used is None else ids[start:end])
            start = end

    for text in texts:
        if len(pool.known) > POOL and not block:
            pool = vocabulary.pool = Pool()
        block.append(None if text is None else pool.numbers(text, vocabulary) if text else [])
        size += len(text or "")
        if size >= BLOCK:
            flush()
            block, size = [], 0
    flush()
    return out


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    v = vocabulary
    if 200 < len(ids) < 200_000:
        data = v.flat[_ragged(v.places[ids], v.widths[ids])].tobytes()
    else:
        data = b"".join(map(v.out.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "surrogatepass") if data[:1] == b" " else data.decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _held(path: str) -> Vocabulary:
    return load(path)


def coders(vocabulary: Vocabulary, spark) -> tuple:
    """Column functions: text to array of ids, and back. The vocabulary is broadcast; its size is the model file's."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_ids(text: pd.Series) -> pd.Series:
        return pd.Series(encode([None if x is None or x is pd.NA else x for x in text], held.value), dtype=object)

    @F.pandas_udf(T.StringType())
    def to_text(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(x, held.value) for x in ids], dtype=object)

    return to_ids, to_text


def read_back(vocabulary: Vocabulary, spark):
    """Column function: text to a struct of ``ids`` and ``text``, which is read back from them. Where both are wanted, texts are encoded once; with the two
    functions of :func:`coders`, one over the other, Spark calls the first for each."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("text", T.StringType()))
    def both(text: pd.Series) -> pd.DataFrame:
        ids = encode([None if x is None or x is pd.NA else x for x in text], held.value)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": pd.Series([None if x is None else decode(x, held.value) for x in ids], dtype=object)})

    return both


def byte_pieces(ids: Column, vocabulary: Vocabulary) -> Column:
    """How many of the ids are byte pieces (which lie together in a model)."""
    low, high = int(vocabulary.byte_ids.min()), int(vocabulary.byte_ids.max())
    return F.size(F.filter(ids, lambda x: x.between(low, high)))


def model_path(spark) -> str:
    """The model that the session names in ``spark.reportmill.sentencepiece.model``, else the public one of this installation."""
    return spark.conf.get("spark.reportmill.sentencepiece.model", MODEL)


def vocabulary(path: str = MODEL) -> Vocabulary:
    """The model of a path, loaded once."""
    return _held(path)
