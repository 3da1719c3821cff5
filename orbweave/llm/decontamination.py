"""Benchmark decontamination by SimHash windows.

A benchmark item of w words is held against every stretch of w words of a document, and against the whole of a document that has
fewer. An item of fewer than five words is one shingle of all of them. Each stretch and each item has a SimHash
of 64 bits, from its five-word shingles, each weighted by the letters of its words. Fingerprints are compared in BLOCKS: two
within RADIUS agree within RADIUS // BLOCKS bits in one block at least, so no candidate within the radius is missed.
Candidates are then verified by their exact weighted similarity, sum of minima over sum of maxima, of the shingles as words.

A stretch that shares no shingle with an item has similarity 0 to it. So the benchmark's shingles are probed first: a document meets
only items that it shares a shingle with, and of these only those of which its shared shingles could make up the threshold, and
only stretches around a shared shingle are fingerprinted. Hashes lead to shingles; their words decide whether they are shared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, materialise
from .common import blocks, bounded_batches, table
from .substring_dedup import Words

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Words of benchmark text in one index, which the driver builds and every task holds; a larger benchmark takes several passes over the documents.
INDEX_WORDS = 200_000
#: Windows that are fingerprinted together.
STRETCH = 4096
#: Bits of the table that turns away most shingles at one look.
LOOK = 22

_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)


def _lower(column: pa.Array) -> Words:
    return Words(pa.array([(t or "").lower() for t in column.to_pylist()], pa.string()), 1)


def _weights(words: Words, n: int) -> np.ndarray:
    """The weight (bytes of the words) of the n words from each word on (meaningless where a text ends before)."""
    total = np.append(0, np.cumsum(words.end - words.begin)).astype(np.float64)
    last = np.minimum(np.arange(len(words.begin)) + n, len(words.begin))
    return total[last] - total[:-1]


def simhash(h: np.ndarray, weight: np.ndarray) -> int:
    """The signs of the weighted sum of the shingles' bits."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).astype(np.float32) * 2 - 1
    return int(np.packbits(weight @ bits > 0).view(np.uint64)[0])


class Shelf:
    """The items of one shingle length: their shingles as words and as hashes, which items have each, and the items' fingerprints."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.known: dict[bytes, int] = {}
        self.having: list[list[int]] = []  # of each shingle, the items
        self.ids: list = []
        self.size: list[int] = []
        self.bags: list[dict[int, int]] = []
        self.total: list[float] = []
        self.print: list[int] = []
        self._hashes: list[np.ndarray] = []

    def add(self, item, words: Words) -> None:
        n, raw = int(words.count[0]), words.data.tobytes()
        span = n - self.length + 1
        h, weight = words.hashes(self.length)[:span], _weights(words, self.length)[:span]
        bag: Counter[int] = Counter()
        for k in range(span):
            shingle = b" ".join(raw[words.begin[k] : words.end[k + self.length - 1]].split())
            number = self.known.setdefault(shingle, len(self.known))
            if number == len(self.having):
                self.having.append([])
            if not bag[number]:
                self.having[number].append(len(self.ids))
            bag[number] += 1
        self.ids.append(item)
        self.size.append(n)
        self.bags.append(dict(bag))
        self.total.append(float(weight.sum()))
        self.print.append(simhash(h, weight))
        self._hashes.append(h)

    def close(self) -> None:
        """Call when all items are there."""
        self.hashes = np.unique(np.concatenate(self._hashes))
        self._hashes = []

    def look(self) -> np.ndarray:
        out = np.zeros(1 << LOOK, bool)
        out[(self.hashes >> np.uint64(64 - LOOK)).astype(np.int64)] = True
        return out

    def near(self, k: int, prints: np.ndarray) -> np.ndarray:
        """Which fingerprints lie within RADIUS of item k's: in one block at least they differ by RADIUS // BLOCKS bits at most."""
        differ = _ONES[(prints ^ np.uint64(self.print[k])).view(np.uint8).reshape(len(prints), BLOCKS)]
        some = np.flatnonzero((differ <= RADIUS // BLOCKS).any(axis=1))
        return some[differ[some].sum(axis=1) <= RADIUS]

    def search(self, h: np.ndarray, weight: np.ndarray, shared: list[tuple[int, int]], n_words: int, threshold: float) -> dict[int, tuple[float, int]]:
        """For one text (hashes and weights of its shingles; place and number of those it shares with any item, by place): the items found,
        each with its best window's similarity and that window's first word."""
        out: dict[int, tuple[float, int]] = {}
        meets: dict[int, list[tuple[int, int]]] = {}
        for place, number in shared:
            for k in self.having[number]:
                meets.setdefault(k, []).append((place, number))
        for k in sorted(meets):
            if len(self.bags[k]) == 1 and self.size[k] == self.length:  # the item is one shingle
                out[k] = (1.0, meets[k][0][0])
                continue
            at = np.array([place for place, _ in meets[k]])
            if weight[at].sum() < threshold * self.total[k] - 1e-6:
                continue
            length = min(self.size[k], n_words)  # a text shorter than the item is one window
            span = length - self.length + 1  # shingles of a window
            cover = np.zeros(n_words - length + 2, np.int64)  # the windows that hold a shared shingle
            np.add.at(cover, np.clip(at - span + 1, 0, len(cover) - 1), 1)
            np.add.at(cover, np.clip(at + 1, 0, len(cover) - 1), -1)
            starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for low in range(0, len(run), STRETCH):
                    some = run[low : low + STRETCH]
                    a, b = int(some[0]), int(some[-1]) + span
                    bits = (np.unpackbits(h[a:b].view(np.uint8).reshape(b - a, 8), axis=1).astype(np.float64) * 2 - 1) * weight[a:b, None]
                    sums = np.vstack([np.zeros((1, 64)), np.cumsum(bits, axis=0)])
                    prints = np.packbits(sums[some - a + span] - sums[some - a] > 0, axis=1).view(np.uint64)[:, 0]
                    for s in some[self.near(k, prints)].tolist():
                        value = self._similarity(k, meets[k], at, weight, s, span)
                        if value >= threshold - 1e-9 and value > out.get(k, (0.0, 0))[0]:
                            out[k] = (value, s)
        return out

    def _similarity(self, k: int, shared: list[tuple[int, int]], at: np.ndarray, weight: np.ndarray, s: int, span: int) -> float:
        """The weight of what the window from s on and item k share (by multiplicity) over the weight of what either has."""
        common, left = 0.0, dict(self.bags[k])
        for place, number in shared[int(np.searchsorted(at, s)) : int(np.searchsorted(at, s + span))]:
            if left[number]:
                left[number] -= 1
                common += float(weight[place])
        return common / max(float(weight[s : s + span].sum()) + self.total[k] - common, 1e-12)


def _indexes(benchmark: DataFrame, item_id: str, text: str, shingle: int) -> Iterator[list[Shelf]]:
    """Indexes over all items, each of at most INDEX_WORDS words and one item more. Items of fewer than `shingle` words have one shingle, all their words."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("i IS NOT NULL").distinct().orderBy("i", "t")
    shelves: dict[int, Shelf] = {}
    size = 0

    def closed() -> list[Shelf]:
        for shelf in shelves.values():
            shelf.close()
        return [shelves[k] for k in sorted(shelves)]

    for row in rows.toLocalIterator():
        words = _lower(pa.array([row["t"]], pa.string()))
        n = int(words.count[0])
        if n:
            length = min(n, shingle)
            shelves.setdefault(length, Shelf(length)).add(row["i"], words)
            size += n
        if size >= INDEX_WORDS:
            yield closed()
            shelves, size = {}, 0
    if shelves:
        yield closed()


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, text: str = "text", item_id: str = "item_id", to: str = "hits") -> DataFrame:
    """docs with one more column, hits: for each benchmark item found in text (item_id, similarity, word), the best window's similarity
    and the number of the word it starts at, by item_id.

    Words are runs without white space, in lower case. An item of fewer than `shingle` words is found where all its words stand
    in a row (similarity 1). An item without words, a null item and a null id find nothing; a null or empty text has no hits, and a text shorter than an item is held against it as a whole. Whole texts are
    read; rows that repeat get equal results; an empty docs table gives an empty one, an empty benchmark no hits.
    item_id may be of any type that has an order; other columns stay as they are; a column called `to` is replaced.

    A plan holds one index. Where the benchmark has more words than that, each pass is written before the next one starts.
    """
    bounded_batches(docs.sparkSession)
    own = "_ow_text"
    field = benchmark.schema[item_id].dataType
    hit = f"array<struct<item_id:{field.simpleString()},similarity:double,word:int>>"
    out = docs.drop(to).withColumn(to, F.array().cast(hit)).withColumn(own, F.col(text))
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(field)), ("similarity", pa.float64()), ("word", pa.int32())]))
    at, schema = out.columns.index(to), ", ".join(f"`{c}` {t}" for c, t in out.dtypes)

    def looked(rows: DataFrame, shelves: list[Shelf]) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [shelf.look() for shelf in shelves]
            for block in blocks(batches, own):
                words = _lower(block.column(own))
                found: dict[int, list[dict]] = {}
                for shelf, seen in zip(shelves, tables, strict=True):
                    for k, hits in _found(words, shelf, seen, threshold):
                        found.setdefault(k, []).extend({"item_id": shelf.ids[i], "similarity": round(v, 6), "word": s} for i, (v, s) in hits.items())
                columns = list(block.columns)
                if found:
                    hits = block.column(to).to_pylist()
                    for k, new in found.items():
                        hits[k] = sorted(hits[k] + new, key=lambda x: x["item_id"])
                    columns[at] = pa.array(hits, arrow)
                yield pa.RecordBatch.from_arrays(columns, block.schema.names)

        return rows.mapInArrow(look, schema)

    before = None
    for k, shelves in enumerate(_indexes(benchmark, item_id, "text", shingle)):
        if k:
            out = materialise(out, "looked")
            if before is not None:
                discard(before)
            before = out
        out = looked(out, shelves)
    return out.drop(own)


def _found(words: Words, shelf: Shelf, seen: np.ndarray, threshold: float) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
    """The texts of a block that hold items of a shelf, with what search says of them."""
    n = shelf.length
    if not len(words.begin):
        return
    h = words.hashes(n)
    whole = np.arange(len(h)) + n <= np.repeat(words.first[1:], words.count)
    some = np.flatnonzero(whole & seen[(h >> np.uint64(64 - LOOK)).astype(np.int64)])
    some = some[np.isin(h[some], shelf.hashes)]
    if not len(some):
        return
    raw, weight = words.data.tobytes(), _weights(words, n)
    edges = np.searchsorted(some, words.first)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        a = int(words.first[k])
        shared = []
        for place in some[edges[k] : edges[k + 1]].tolist():
            number = shelf.known.get(b" ".join(raw[words.begin[place] : words.end[place + n - 1]].split()))
            if number is not None:
                shared.append((place - a, number))
        if shared:
            end = a + int(words.count[k]) - n + 1
            hits = shelf.search(h[a:end], weight[a:end], shared, int(words.count[k]), threshold)
            if hits:
                yield k, hits


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["similarity"])), F.lit(0.0)).alias("similarity"),
    )
