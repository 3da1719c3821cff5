"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the different words of its documents, and merges them all together: an inverted index leads from each
rank to the positions of its token pair, in whatever word; ranks are taken in order from a heap, every position of the
rank is merged at once, and only the two neighbours of a merge get a new rank and a new entry. A merge that makes a
pair of a lower rank brings that rank to the top of the heap, so each word is merged as if alone: lowest rank first,
leftmost first. Documents are then strings of words whose ids are known.

Nothing is trained and nothing is shuffled: tasks are independent, and a task holds a stretch of at most
STRETCH_BYTES of text, or one longer text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, exact_numbers, table, utf8

STRETCH_BYTES = 6_000_000
#: The name of the column that workers read and replace.
OWN = "_ow_payload"
LETTER, NUMBER, SPACE, OTHER = range(4)
#: The code points of the White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in rank order."""
    with open(path, "rb") as lines:
        ranks = {int(n): base64.b64decode(token) for token, n in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte positions at which a word starts, over all texts, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ applied to each text alone."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[at]
    kind = _classes()[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(len(at), bool)
    after_blank[1:] = (points[:-1] == 0x20) & ~first[1:]
    blank = kind == SPACE
    start = first | (run & (blank | ~after_blank))
    last = np.zeros(len(at), bool)  # white space right before something else of the same text
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    start |= last
    quotes = np.flatnonzero((points == 0x27) & run & start)
    if len(quotes):
        end = np.append(np.flatnonzero(first)[1:], len(at))[np.cumsum(first)[quotes] - 1]
        ahead = lambda k: np.where(quotes + k < end, points[np.minimum(quotes + k, len(at) - 1)], 0)
        a, b = ahead(1), ahead(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, n in ((one, 2), (two, 3)):
            q, stop = quotes[hit], end[hit]
            start[q + 1] = False
            rest = q + n
            rest = rest[rest < stop]
            start[rest[kind[rest] == LETTER]] = True
    return at[start]


class Merges:
    """The merge table: single bytes' ids, and the rank of each pair of ids (-1: none)."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, number = tokens, {t: i for i, t in enumerate(tokens)}
        self.single = np.array([number[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = number.get(t[:k]), number.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        code = np.fromiter(pairs, np.uint64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs))))) + 2)  # an open-addressed table, a quarter full at most
        self.keys, self.ranks = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self._slot(code), np.arange(len(code))
        while len(left):
            free = self.keys[slot[left]] == np.iinfo(np.uint64).max
            take, where = np.unique(slot[left[free]], return_index=True)
            won = left[free][where]
            self.keys[take], self.ranks[take] = code[won], rank[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(code)
        found, out = self.keys[slot], self.ranks[slot]
        left = np.flatnonzero((found != code) & (out >= 0))
        if len(left):
            out = out.copy()
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.ranks[slot[left]]
            left = left[(self.keys[slot[left]] != code[left]) & (out[left] >= 0)]
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.single.astype(np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(length)
        after[ends[length > 0] - 1] = -1
        before[(ends - length)[length > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, -1, np.int32)
        has = np.flatnonzero(after >= 0)
        rank[has] = self.rank(symbol[has], symbol[after[has]])
        del has
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            edge = np.flatnonzero(np.diff(ranks)) + 1
            for r, some in zip(ranks[np.append(0, edge)].tolist(), np.split(positions, edge), strict=True):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(rank >= 0).astype(np.int32)
        if len(some):
            enter(some, rank[some])
        del some
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                at, later = self._together(r, at, symbol, after, before, rank, word)
                if len(later):
                    enter(later, np.full(len(later), r))
            right = after[at]
            right_of, left_of = after[right], before[at]
            symbol[at] = r
            alive[right] = False
            rank[right] = -1
            after[at] = right_of
            has = right_of >= 0
            before[right_of[has]] = at[has]
            left_of = before[at]
            left = left_of[left_of >= 0]
            rank[at] = -1
            touched = np.concatenate((at[has], left))
            if len(touched):
                new = self.rank(symbol[touched], symbol[after[touched]])
                rank[touched] = new
                some = new >= 0
                if some.any():
                    enter(touched[some], new[some])
        return symbol[alive], np.bincount(word[alive], minlength=len(words))

    def _together(self, r, at, symbol, after, before, rank, word):
        """Which of the positions, in order, may be merged now: of overlapping ones every other, from the left; of a
        word in which one of these merges makes a pair of a lower rank, the first alone. The rest are left for later."""
        joined = np.zeros(len(at), bool)
        joined[1:] = at[1:] == after[at[:-1]]
        n = np.arange(len(at))
        chain = np.maximum.accumulate(np.where(joined, 0, n))
        take = at[(n - chain) % 2 == 0]
        first = np.ones(len(take), bool)
        first[1:] = word[take[1:]] != word[take[:-1]]
        if first.all():
            return take, take[:0]
        left, right = before[take], after[after[take]]
        merged = np.zeros(len(take), bool)
        merged[1:] = after[take[:-1]] == left[1:]
        low = np.zeros(len(take), bool)
        own = np.full(len(take), r)
        for there, a, b in ((left >= 0, np.where(merged, r, symbol[left]), own), (right >= 0, own, symbol[right])):
            new = self.rank(a[there], b[there])
            low[there] |= (new >= 0) & (new < r)
        if not low.any():
            return take, take[:0]
        careful = np.isin(word[take], word[take[low]])
        later = np.isin(word[at], word[take[low]])
        go = ~careful | first
        return take[go], np.setdiff1d(at[later], take[go])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a string of ids."""
        length = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(length) - length), length)
        return self.bytes[shift + np.arange(len(shift))]


@functools.lru_cache(2)
def _merges(tokens: tuple[bytes, ...]) -> Merges:
    return Merges(list(tokens))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts, the number of the word at each place, and each text's number of places."""
    starts = split(data, offsets)
    ends = np.append(starts[1:], len(data))
    numbers, example = exact_numbers(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
    places = np.diff(np.searchsorted(starts, offsets))
    return words, numbers, places


def encode_batches(batches: Iterator[pa.RecordBatch], tokens: tuple[bytes, ...], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches with text become batches with ids in its place, as little-endian 32-bit lists."""
    merges = _merges(tokens)

    def finish(held: list, known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        ids, count = merges.replay(list(known))
        begin = np.cumsum(count) - count
        for rest, numbers, places in held:
            n = count[numbers]
            shift = np.repeat(begin[numbers] - (np.cumsum(n) - n), n)
            own = ids[shift + np.arange(len(shift))].astype(np.int32)
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(places))]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays([*rest.columns, lists], [*rest.schema.names, "ids"])

    held, known, size = [], {}, 0
    for block in blocks(batches, text):
        data, offsets = utf8(block.column(text))
        words, numbers, places = words_of(data, offsets)
        here = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        held.append((block.drop_columns([text]), here[numbers].astype(np.int32), places))
        size += len(data)
        if size >= STRETCH_BYTES:
            yield from finish(held, known)
            held, known, size = [], {}, 0
    if held:
        yield from finish(held, known)


def decode_batches(batches: Iterator[pa.RecordBatch], tokens: tuple[bytes, ...], ids: str = "ids") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the decoded bytes of its rows' ids."""
    merges = _merges(tokens)
    for batch in batches:
        lists = batch.column(ids)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        yield batch, [merges.spell(flat[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _select(df: DataFrame, column: str, name: str) -> tuple[DataFrame, str]:
    """The other columns of df and, last, this one under a name of the workers' own; and the others' schema. A column that has the new one's name goes."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (column, name)]
    return df.select(*rest, F.col(column).alias(OWN)), ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in rest)


def encode(df: DataFrame, ranks: str | None = None, text: str = "text") -> DataFrame:
    """df with text replaced by ids (array of int), the ids that the rank file gives.

    A null text counts as empty and has no ids. Texts may be of any length, rows may repeat, and an empty table gives an
    empty result. The other columns stay as they are; one called ids is replaced.
    """
    tokens = tuple(read_ranks(ranks or default_ranks()))
    rows, schema = _select(df, text, "ids")
    return rows.mapInArrow(lambda batches: encode_batches(batches, tokens, OWN), ", ".join(filter(None, [schema, "ids array<int>"])))


def decode(df: DataFrame, ranks: str | None = None, ids: str = "ids") -> DataFrame:
    """df with ids replaced by text (string; bytes that are no UTF-8 become U+FFFD); null ids give an empty text. A column called text is replaced."""
    tokens = tuple(read_ranks(ranks or default_ranks()))
    rows, schema = _select(df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>"))), ids, "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in decode_batches(batches, tokens, OWN):
            rest = batch.drop_columns([OWN])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [*rest.schema.names, "text"])

    return rows.mapInArrow(spell, ", ".join(filter(None, [schema, "text string"])))


def digests(df: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    tokens = tuple(read_ranks(ranks or default_ranks()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in decode_batches(encode_batches(batches, tokens), tokens):
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            ids = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(ids, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), *[lists] * with_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(digest, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
