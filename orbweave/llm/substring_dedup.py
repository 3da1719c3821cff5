"""Substring dedup by level-wise doubling.

A window of `window` words that occurs twice holds only parts that occur twice. So repeats are first sought at a short
length, where every window is stood for by one part of its own, the one with the least hash (equal windows choose
equal parts, so nothing is lost, and only about one part in ten is counted); windows whose part is repeated, and those
alone, go on to twice the length, until `window` itself is reached or no candidate survives. At that last length each
surviving window is counted whole, by the 128-bit BLAKE2b digest of its words: hashes propose, and digests of the words decide.

Counting is one shuffle of rows of fixed width: a block of documents sends each of its different identifiers once (one that
occurs twice in the block, twice), sorted tasks find those that stand more than once, and send back to each block the places
of its own. So rows grow with the corpus and with nothing else, and the commonest passage costs a block one row. Only documents
with a candidate move their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import blocks, bounded_batches, exact_numbers, mix64, row_key, span_hashes, table, utf8

#: Bytes of text in a block.
BLOCK = 2_000_000
#: The shortest length at which repeats are sought.
SHORTEST = 8
#: Places that a task gathers before it sends them back.
PLACES = 1_000_000


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths from the shortest up to window, each at most twice the one before: 35 gives [9, 18, 35]."""
    out = [window]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """The words of a block of texts, one text after the other."""

    def __init__(self, column: pa.Array, window: int) -> None:
        self.data, self.offsets = utf8(column)
        self.window = window
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        self.begin = np.flatnonzero(~blank & (edge[:-1] | np.append(True, blank[:-1])[: len(blank)]))
        self.end = np.flatnonzero(~blank & (edge[1:] | np.append(blank[1:], True)[: len(blank)])) + 1
        self.first = np.searchsorted(self.begin, self.offsets)  # of each text, and the end
        self.count = np.diff(self.first)
        stop = np.repeat(self.first[1:], self.count)
        self.whole = np.arange(len(self.begin)) + window <= stop  # at which words a window starts
        self._one: np.ndarray | None = None

    def hashes(self, length: int) -> np.ndarray:
        """A hash of the `length` words from each word on (meaningless where a text ends before); equal words have equal hashes."""
        if self._one is None:
            self._one = span_hashes(self.data, self.begin, self.end)
        return self._doubled(self._one, length, lambda a, b: mix64(a * np.uint64(0xD6E8FEB86659FD93) + b))

    def numbers(self, length: int) -> np.ndarray:
        """As hashes, but exact: within the block, equal numbers mean equal words."""
        return self._doubled(exact_numbers(self.data, self.begin, self.end)[0], length, lambda a, b: pd.factorize(a << 32 | b)[0])

    @staticmethod
    def _doubled(one: np.ndarray, length: int, joined) -> np.ndarray:
        def pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
            later = np.zeros_like(b)
            later[: max(0, len(b) - shift)] = b[shift:]
            return joined(a, later)

        h, power, out, done = one, 1, None, 0
        while power <= length:
            if length & power:
                out, done = (h, power) if out is None else (pair(out, h, done), done + power)
            if power * 2 <= length:
                h = pair(h, h, power)
            power *= 2
        return out

    def digests(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit BLAKE2b digests of the `length` words from some words on, joined by one space, as two columns."""
        size = self.end - self.begin
        start = np.cumsum(size + 1) - (size + 1)
        of = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # each byte's place in its word
        plain = np.full(int((size + 1).sum()), 32, np.uint8)
        plain[np.repeat(start, size) + of] = self.data[np.repeat(self.begin, size) + of]
        raw, last = plain.tobytes(), at + length - 1
        blake = hashlib.blake2b
        out = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), (start[last] + size[last]).tolist(), strict=True)])
        both = np.frombuffer(out, "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def parts(self, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows' parts of this length: their hashes in order of place, the alive windows, and the number of each one's part."""
        windows = np.flatnonzero(alive)
        h = self.hashes(length)
        if length == self.window:
            return h[windows], windows, np.arange(len(windows))
        reach = self.window - length + 1
        best, span = np.arange(len(h)), 1
        while span < reach:  # least of `span` parts from each on, the leftmost of equals
            step = min(span, reach - span)
            a, b = best[:-step], best[step:]
            best = np.append(np.where(h[b] < h[a], b, a), best[len(best) - step :])
            span += step
        chosen = np.zeros(len(h), bool)
        chosen[best[windows]] = True
        number = np.cumsum(chosen) - 1
        return h[chosen], windows, number[best[windows]]


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def distinct(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of identifiers (h, or h and c together): where each different one stands, which occur twice, and the number of each identifier's."""
    order = np.argsort(h, kind="stable") if c is None else np.lexsort((c, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if c is not None:
        new[1:] |= c[order][1:] != c[order][:-1]
    at = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], np.diff(np.append(at, len(h))) > 1, number


def repeated(rows: DataFrame, ids: list[str]) -> DataFrame:
    """From rows (ids, src, i), those whose ids stand in more than one row: for each src, the list told of packed numbers i."""
    names = [*ids, "src", "i"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in names]  # the last row so far
        src, i, size = [], [], 0

        def tell() -> Iterator[pa.RecordBatch]:
            s, k = np.concatenate(src), np.concatenate(i)
            order = np.argsort(s, kind="stable")
            s, k = s[order], k[order].astype(np.int32)
            edge = np.flatnonzero(np.diff(s)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(s[np.append(0, edge)]), pa.array([x.tobytes() for x in np.split(k, edge)], pa.binary())], ["src", "at"])

        again_before = False  # whether the row held over is known to be repeated
        for batch in _then_none(batches):
            if batch is None:
                columns, last = held, True
            else:
                columns, last = [np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(held, names, strict=True)], False
            n = len(columns[0])
            if not n:
                continue
            same = np.ones(n - 1, bool)
            for c in columns[: len(ids)]:
                same &= c[1:] == c[:-1]
            again = np.append(again_before, same) | np.append(same, False)
            done = n if last else n - 1  # the last row waits for what follows it
            hit = np.flatnonzero(again[:done])
            if len(hit):
                src.append(columns[-2][hit])
                i.append(columns[-1][hit])
                size += len(hit)
            if size >= PLACES or (last and size):
                yield from tell()
                src, i, size = [], [], 0
            if not last:
                again_before, held = bool(again[-1]), [c[-1:] for c in columns]

    dealt = rows.select(*names).repartition(*ids).sortWithinPartitions(*ids)
    return dealt.mapInArrow(runs, "src long, at binary").groupBy("src").agg(F.collect_list("at").alias("told"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sent(h: np.ndarray, c: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """What a block keeps to be counted: [different identifiers h, c, which occur twice], and the number of each identifier's."""
    at, twice, number = distinct(h, c)
    return [h[at].tobytes(), b"" if c is None else c[at].tobytes(), _packed(twice)], number


def _rows(state: DataFrame, wide: bool) -> DataFrame:
    """The rows to be counted (h, with c if wide, src, i) of blocks that keep them as _sent says."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.frombuffer(row["h"], np.int64)
                i = np.append(np.arange(len(h)), np.flatnonzero(_unpacked(row["twice"], len(h)))).astype(np.int32)
                c = [pa.array(np.frombuffer(row["c"], np.int64)[i])] if wide else []
                for low in range(0, len(i), 500_000):
                    s = slice(low, low + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[i[s]]), *(x[s] for x in c), pa.array(np.full(len(i[s]), row["src"])), pa.array(i[s])], ["h", *["c"] * wide, "src", "i"])

    return state.select("src", "h", *["c"] * wide, "twice").mapInArrow(spread, f"h long, {'c long, ' * wide}src long, i int")


def _told(told: list[bytes] | None, number: np.ndarray) -> np.ndarray:
    """Whether each identifier of a block is repeated; number: which of the different ones it is."""
    flags = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)
    for at in told or []:
        flags[np.frombuffer(at, np.int32)] = True
    return flags[number]


def _sources() -> Iterator[int]:
    context = TaskContext.get()
    n = (context.partitionId() if context else 0) << 32
    while True:
        yield n
        n += 1


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def substring_dedup(df: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing was removed).

    Words are runs of other characters than the space and 0x09 to 0x0D, unchanged. A word is removed if a window covers it
    whose words, in order, also start anywhere else, in the same text or another; windows are judged on the input. A null
    or empty text has no words, and one shorter than the window loses none. Rows that repeat are repeats of each other
    and lose every window. Texts may be of any length. An empty table gives an empty result; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    steps = levels(window, shortest)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_key(doc_id, text).alias("key"))

    def first_parts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The parts of the first length, the windows, each one's part, and the number of parts of each text."""
        h, windows, part = words.parts(steps[0], words.whole)
        place = np.searchsorted(windows, words.first)  # of each text's first window
        bounds = np.append(part, len(h))[place] if len(part) else np.zeros(len(place), np.int64)
        return h, windows, part, np.diff(np.minimum(bounds, len(h)))

    # The first length, over all documents: a row for each block.
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = _sources()
        for block in blocks(batches, "text", BLOCK):
            words = Words(block.column("text"), window)
            h, _, _, counts = first_parts(words)
            raw = words.data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
            kept, number = _sent(h, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(sources)], pa.int64()), _list(block.column("doc_id")), _list(block.column("key")), _list(pa.array(words.count.astype(np.int64))), _list(pa.array(sha, pa.string())), _list(pa.array(counts.astype(np.int64))), pa.array([number.astype(np.int32).tobytes()], pa.binary()), *(pa.array([x], pa.binary()) for x in kept)],
                ["src", "doc_id", "key", "n_words", "sha", "parts", "number", "h", "c", "twice"],
            )

    state = materialise(docs.mapInArrow(survey, f"src long, doc_id array<{kind}>, key array<binary>, n_words array<long>, sha array<string>, parts array<long>, number binary, h binary, c binary, twice binary"), "survey")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                flags = _told(row.column("told")[0].as_py(), np.frombuffer(row.column("number")[0].as_py(), np.int32))
                edges = np.cumsum(row.column("parts").flatten().to_numpy())[:-1]
                bits = [_packed(x) if x.any() else None for x in np.split(flags, edges)]
                yield pa.RecordBatch.from_arrays([*(row.column(c).flatten() for c in ("doc_id", "key", "n_words", "sha")), pa.array(bits, pa.binary())], ["doc_id", "key", "n_words", "sha", "bits"])

    told = materialise(repeated(_rows(state, False), ["h"]), "told")
    found = materialise(state.join(told, "src", "left").select("doc_id", "key", "n_words", "sha", "parts", "number", "told").mapInArrow(report, f"doc_id {kind}, key binary, n_words long, sha string, bits binary"), "found")
    discard(state)
    discard(told)
    clean = found.filter("bits IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))

    # Documents with candidates, with their text: again a row for each block, and what it counts at the next length.
    marked = found.filter("bits IS NOT NULL").select("key", "bits").dropDuplicates(["key"])

    def block_row(src: int, ids: pa.Array, texts: pa.Array, words: Words, alive: np.ndarray, length: int) -> pa.RecordBatch:
        if length == window:
            at = np.flatnonzero(alive)
            kept, number = _sent(*words.digests(window, at))
        else:
            h, _, part = words.parts(length, alive)
            kept, number = _sent(h, None)
            number = number[part]
        cells = [_packed(alive), number.astype(np.int32).tobytes(), *kept]
        return pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), _list(ids), _list(texts), *(pa.array([x], pa.binary()) for x in cells)], ["src", "doc_id", "text", "alive", "number", "h", "c", "twice"])

    rest = steps[1:] or steps

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = _sources()
        for block in blocks(batches, "text", BLOCK):
            words = Words(block.column("text"), window)
            _, windows, part, counts = first_parts(words)
            flags = np.concatenate([np.zeros(0, bool), *(_unpacked(b, n) for b, n in zip(block.column("bits").to_pylist(), counts.tolist(), strict=True))])
            alive = np.zeros(len(words.begin), bool)
            alive[windows] = flags[part]
            yield block_row(next(sources), block.column("doc_id"), block.column("text"), words, alive, rest[0])

    schema = f"src long, doc_id array<{kind}>, text array<string>, alive binary, number binary, h binary, c binary, twice binary"
    stage = materialise(docs.join(marked, "key").select("doc_id", "text", "bits").mapInArrow(admit, schema), "candidates")
    for length, after in zip(rest, [*rest[1:], None], strict=True):

        def settle(batches: Iterator[pa.RecordBatch], after=after) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    words = Words(row.column("text").flatten(), window)
                    alive = _unpacked(row.column("alive")[0].as_py(), len(words.begin))
                    alive[alive] = _told(row.column("told")[0].as_py(), np.frombuffer(row.column("number")[0].as_py(), np.int32))
                    if after is None:
                        yield _removed(row, words, alive)
                    else:
                        yield block_row(row.column("src")[0].as_py(), row.column("doc_id").flatten(), row.column("text").flatten(), words, alive, after)

        last = length == window
        told = materialise(repeated(_rows(stage, last), ["h", "c"] if last else ["h"]), "told")
        joined = stage.join(told, "src", "left").select("src", "doc_id", "text", "alive", "number", "told")
        if last:
            return clean.unionByName(joined.mapInArrow(settle, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"))
        before, stage = stage, materialise(joined.mapInArrow(settle, schema), "candidates")
        discard(before)
        discard(told)
    raise AssertionError("the last length is the window")


def _removed(row: pa.RecordBatch, words: Words, alive: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(alive)
    depth = np.zeros(len(words.begin) + 1, np.int64)
    depth[at] += 1
    np.subtract.at(depth, at + words.window, 1)
    gone = np.cumsum(depth)[:-1] > 0
    raw = words.data.tobytes()
    begin, end, first = words.begin.tolist(), words.end.tolist(), words.first.tolist()
    keep = np.flatnonzero(~gone)
    edges = np.searchsorted(keep, first).tolist()
    keep = keep.tolist()
    kept = [b" ".join([raw[begin[i] : end[i]] for i in keep[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    total = np.append(0, np.cumsum(gone))[words.first]
    removed = np.diff(total)
    texts = [t.decode() if n else None for t, n in zip(kept, removed.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([row.column("doc_id").flatten(), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), 35).drop("kept_text")


SQL = """
WITH w AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), starts AS (
  SELECT r, s, list_aggregate(words[s : s + 34], 'string_agg', ' ') AS span
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35)
), twice AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY span) AS n FROM starts) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM twice
), lost AS (
  SELECT r, list(i) AS ids, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(ids, i)), lambda i: words[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)
"""
