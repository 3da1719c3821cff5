"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its five-word shingles. Each different text (as a string of words) has TREES labels of DEPTH minhashes, one in each tree of the
forest; a tree is the sorted prefix trie of its labels. Texts whose label's prefix stands alone at the shortest depth that the
target recall allows are dropped first, in one shuffle of narrow rows. What is left lies in subtries, each sorted by label
and searched from its leaves up: at depth DEPTH only texts of one whole label meet, and a prefix is shortened by one minhash as long as the
subtrie is not yet one component and until the depth of the target recall. A crowded subtrie is dealt in parts, and every
two parts meet in a task of their own.

Where texts meet, an edge joins those whose estimate from all minhashes is within SLACK of the threshold. In a component of
such edges all pairs are then verified by their exact sets of shingles, which are numbered by comparing words, not
hashes; a prefix filter finds which rows can meet, and blocks of them are multiplied as matrices. Only each text's number of links and
one edge towards its group leave the task, so no pair is ever a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import blocks, bounded_batches, broadcast_if_small, mix64, row_key, table, table64, without
from .components import components
from .substring_dedup import Words, repeated

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 8, 0.9999
#: How far below the threshold an estimate may lie: more than four standard deviations of TREES * DEPTH minhashes.
SLACK = 0.13
#: Texts of a subtrie that meet in one task; a larger one is dealt in parts.
CROWD = 500
#: Shingles, and texts, in a part of a component.
BLOCK_SHINGLES, BLOCK_TEXTS = 500_000, 100_000
#: Rows, columns and shingles of the matrices that are multiplied.
ROWS, COLUMNS, WIDTH = 256, 1024, 4096


def prefix(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which two texts at the threshold meet in some tree with probability recall, at least 1."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def shingles(words: Words, n: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each text's n-word shingles, and where each text's begin (and the end): hashes, in order of place, or, if exact, numbers that are
    equal within these texts where the words are, each once and sorted. A text of fewer words has one shingle, all its words; one without a
    word has none."""
    if not len(words.begin):
        return np.zeros(0, np.int64 if exact else np.uint64), np.zeros(len(words.count) + 1, np.int64)
    own = np.repeat(np.arange(len(words.count)), words.count)
    of = words.numbers if exact else words.hashes
    out, out_own = of(n)[words.whole].astype(np.int64 if exact else np.uint64), own[words.whole]
    above = int(out.max()) + 1 if exact and len(out) else 0
    short = (words.count > 0) & (words.count < n)
    for size in range(1, n) if short.any() else ():  # short texts, by their number of words
        few = np.flatnonzero(words.count == size)
        if len(few):
            some = of(size)[words.first[few]]
            some = some + above if exact else mix64(some.astype(np.uint64) + np.uint64(size))
            above = int(some.max()) + 1 if exact else 0
            out, out_own = np.append(out, some.astype(out.dtype)), np.append(out_own, few)
    if not exact:
        if short.any():
            order = np.argsort(out_own, kind="stable")
            out, out_own = out[order], out_own[order]
        return out, np.searchsorted(out_own, np.arange(len(words.count) + 1))
    order = np.lexsort((out, out_own))
    out, out_own = out[order], out_own[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (out_own[1:] != out_own[:-1])
    out, out_own = out[new], out_own[new]
    return out, np.searchsorted(out_own, np.arange(len(words.count) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes (16 bits of each) of each set; of an empty set all are the largest number."""
    factors = table64(99, TREES * DEPTH) | np.uint64(1)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, len(factors)), 0xFFFF, np.uint16)
    if len(some):
        for k, f in enumerate(factors):
            low = np.minimum.reduceat(((h * f) >> np.uint64(32)).astype(np.uint32), first[some])
            out[some, k] = (low ^ (low >> np.uint32(16))).astype(np.uint16)
    return out


def keys(signature: np.ndarray, length: int) -> np.ndarray:
    """For each row and tree a 64-bit number of the tree and its label's prefix."""
    out = np.zeros((len(signature), TREES), np.uint64)
    seeds, steps = table64(5, TREES), table64(6, length)
    for t in range(TREES):
        x = np.full(len(signature), seeds[t], np.uint64)
        for k in range(length):
            x = mix64(x ^ (signature[:, t * DEPTH + k].astype(np.uint64) + steps[k]))
        out[:, t] = x
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of equal values in the columns `by` (numbers), of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        start = 0
        for edge in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if edge > start:
                held.append(batch.slice(start, edge - start))
            if edge < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            start = edge
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over a task's items; a root is the least of its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, of: np.ndarray) -> np.ndarray:
        return np.array([self.root(k) for k in of.tolist()], np.int64)


def join_subtrie(labels: np.ndarray, sketches: np.ndarray, least: float, shortest: int) -> tuple[list[tuple[int, int]], int]:
    """Edges that span the graph of pairs whose share of equal minhashes is `least` or more, and the depth at which the search ended.

    Rows are sorted by label and searched from the whole label up to the shortest prefix. At each depth, texts of one prefix that are
    not yet in one component are compared; when the subtrie is one component, its prefix is not shortened further.
    """
    need = int(np.ceil(least * sketches.shape[1]))
    if len(labels) == 2:  # nothing to choose: they meet at some depth or other
        near = int((sketches[0] == sketches[1]).sum()) >= need
        return [(0, 1)] * near, int(np.argmin(np.append(labels[0] == labels[1], False))) if near else shortest
    order = np.lexsort(labels.T[::-1])
    labels, sketches = labels[order], sketches[order]
    forest, out, depth = Forest(len(labels)), [], labels.shape[1]
    for depth in range(labels.shape[1], shortest - 1, -1):
        edges = np.flatnonzero((labels[1:, :depth] != labels[:-1, :depth]).any(axis=1)) + 1
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(labels)).tolist(), strict=True):
            if b - a > 1:
                for x, y in _across(sketches[a:b], forest.roots(np.arange(a, b)), need):
                    forest.join(a + x, a + y)
                    out.append((int(order[a + x]), int(order[a + y])))
        if not forest.roots(np.arange(len(labels))).any():
            break
    return out, depth


def _across(sketches: np.ndarray, roots: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Edges between rows of different roots, breadth first: a component that has been reached goes on reaching, as a whole."""
    out, waiting = [], np.arange(len(sketches))
    while len(waiting) > 1:
        own = roots[waiting] == roots[waiting[0]]
        front, waiting = waiting[own].tolist(), waiting[~own]
        while front and len(waiting):
            at = front.pop()
            near = waiting[(sketches[waiting] == sketches[at]).sum(axis=1) >= need]
            if len(near):
                _, first = np.unique(roots[near], return_index=True)  # one edge to each component
                out += [(at, k) for k in near[first].tolist()]
                taken = np.isin(roots[waiting], roots[near])
                front += waiting[taken].tolist()
                waiting = waiting[~taken]
    return out


class Sets:
    """Some sets of numbers, as rows of a sparse matrix whose columns run from the rarest number to the commonest."""

    def __init__(self, values: np.ndarray, first: np.ndarray) -> None:
        _, number, count = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        column = rank[number]
        order = np.lexsort((column, own))
        self.column, self.first, self.size, self.width = column[order], first, np.diff(first), len(count)

    def entries(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first `size` entries of some rows: which of them, and the column."""
        which = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[rows], size)
        return which, self.column[at]


def links(sets: Sets, threshold: float, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i of left, j of right, i < j where both are of both) whose exact Jaccard similarity is the threshold or more.

    Two such sets share one of their rarest numbers: of a set of n, one of the first n - ceil(threshold * n) + 1. So some rows of left meet
    only the rows of right that these lead to, and are multiplied with them in matrices of bounded size.
    """
    lead = sets.size - np.ceil(threshold * sets.size - 1e-6).astype(np.int64) + 1
    lead = np.minimum(np.maximum(lead, 1), sets.size)
    which, column = sets.entries(right, lead[right])
    order = np.argsort(column, kind="stable")
    posted, column = right[which[order]], column[order]  # the rows under each of their leading columns
    same = np.array_equal(left, right)
    local = np.full(sets.width + 1, -1)
    for low in range(0, len(left), ROWS):
        rows = left[low : low + ROWS]
        _, leading = sets.entries(rows, lead[rows])
        leading = np.unique(leading)
        a, b = np.searchsorted(column, leading, "left"), np.searchsorted(column, leading, "right")
        n = b - a
        met = np.unique(posted[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
        x, x_column = sets.entries(rows, sets.size[rows])
        used = np.unique(x_column)
        local[used] = np.arange(len(used))
        x_column = local[x_column]
        for some in range(0, len(met), COLUMNS):
            others = met[some : some + COLUMNS]
            y, y_column = sets.entries(others, sets.size[others])
            y_column = local[y_column]
            y, y_column = y[y_column >= 0], y_column[y_column >= 0]
            common = np.zeros((len(rows), len(others)), np.float32)
            for begin in range(0, len(used), WIDTH):
                p, q = np.zeros((len(rows), min(WIDTH, len(used) - begin)), np.float32), np.zeros((len(others), min(WIDTH, len(used) - begin)), np.float32)
                in_x, in_y = (x_column >= begin) & (x_column < begin + WIDTH), (y_column >= begin) & (y_column < begin + WIDTH)
                p[x[in_x], x_column[in_x] - begin] = 1
                q[y[in_y], y_column[in_y] - begin] = 1
                common += p @ q.T
            union = sets.size[rows][:, None] + sets.size[others][None, :] - common
            i, j = np.nonzero((common >= threshold * union - 1e-6) & (union > 0))
            i, j = rows[i], others[j]
            keep = i < j if same else i != j
            yield i[keep], j[keep]
        local[used] = -1


def near_dedup(df: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, group_id, n_links, kept.

    Words are runs of other characters than white space (the space and 0x09 to 0x0D). class_id is the largest doc_id with the same set of shingles,
    n_links the number of other rows whose similarity is the threshold or more, group_id the largest doc_id that links
    lead to, and kept holds for that one. A null or empty text has no shingle, no link, and a class and group of its
    own. Rows that repeat both doc_id and text are linked to each other and share one fate. An empty table gives an
    empty result; other columns are not read, and texts may be of any length.
    """
    return _linked(df, threshold, shingle, doc_id, text).drop("key")


def kept_rows(df: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that near_dedup keeps, with all their columns: one of each group, and every text without a shingle.

    Rows that stay don't move: only the keys of rows that go, and of rows that repeat one that stays, are held against df.
    """
    marks = _linked(df, threshold, shingle, doc_id, text).groupBy(F.col("key").alias("_ow_mark")).agg(F.max(F.when(F.col("kept"), 1).otherwise(0)).alias("_ow_kept"), F.count("*").alias("_ow_n"))
    marks = materialise(marks.filter("_ow_kept = 0 OR _ow_n > 1"), "marks")
    return without(df.withColumn("_ow_key", row_key(doc_id, text)), marks, F.col("_ow_key") == F.col("_ow_mark"), "_ow_key").select(*df.columns)


def _linked(df: DataFrame, threshold: float, shingle: int, doc_id: str, text: str) -> DataFrame:
    """near_dedup's rows, and the key of each."""
    bounded_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_key(doc_id, text).alias("key"))
    shortest = prefix(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block.column("text"), shingle)
            h, first = shingles(words, shingle)
            s, n = signatures(h, first), np.diff(first)
            raw = words.data.tobytes()
            seq = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() if some else None for a, b, some in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), (n > 0).tolist(), strict=True)]
            whole = keys(s, DEPTH).sum(axis=1, dtype=np.uint64)  # the same for equal sets
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TREES), pa.array(keys(s, shortest).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("key"), pa.array(seq, pa.binary()), pa.array(n.astype(np.int64)), pa.array(whole.view(np.int64)), pa.array([r.tobytes() for r in s], pa.binary()), lists],
                ["doc_id", "key", "seq", "n", "whole", "sketch", "keys"],
            )

    signed = materialise(docs.mapInArrow(sign, f"doc_id {kind}, key binary, seq binary, n long, whole long, sketch binary, keys array<long>"), "signed")
    # A string of words is known by its digest; of its rows the largest doc_id stands for it. From here on it has a number.
    one = signed.filter("seq IS NOT NULL").groupBy("seq").agg(F.max(F.struct("doc_id", "key")).alias("top"), F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("n", "whole", "sketch", "keys")])
    texts = materialise(one.withColumn("cls", F.monotonically_increasing_id()), "texts")

    # Prefixes of the shortest depth that more than one text has.
    told = repeated(texts.select("cls", F.posexplode("keys").alias("i", "h")).select("h", F.col("cls").alias("src"), "i"), ["h"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cls = batch.column("keys"), batch.column("cls").to_numpy()
            every = lists.values.to_numpy()[lists.offsets.to_numpy()[0] :].reshape(-1, TREES)
            trees = [np.frombuffer(b"".join(x), np.int32) for x in batch.column("told").to_pylist()]
            of, tree = np.repeat(np.arange(len(trees)), [len(x) for x in trees]), np.concatenate(trees)
            yield pa.RecordBatch.from_arrays([pa.array(every[of, tree]), pa.array(tree), pa.array(cls[of])], ["bucket", "tree", "cls"])

    meeting = materialise(texts.select("cls", "keys").join(told, F.col("cls") == F.col("src")).select("cls", "keys", "told").mapInArrow(shared, "bucket long, tree int, cls long"), "meeting")
    crowds = meeting.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > CROWD).select("bucket", F.ceil(F.col("size") / CROWD).cast("int").alias("parts"))
    placed = meeting.join(crowds, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("pair", F.explode(_pairs(F.pmod(F.xxhash64("cls", "bucket"), "parts").cast("int")))).select("bucket", "pair.i", "pair.j", "tree", "cls")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "i", "j"]):
            cls, tree = group.column("cls").to_numpy(), group.column("tree")[0].as_py()
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(cls), -1)
            edges, _ = join_subtrie(sketches[:, tree * DEPTH : (tree + 1) * DEPTH], sketches, threshold - SLACK, shortest)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], ["a", "b"])

    dealt = placed.join(texts.select("cls", "sketch"), "cls").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = materialise(components(dealt.mapInArrow(meet, "a long, b long")), "components")
    discard(meeting)

    # Verification: the texts of a component meet in one task, or part by part in several.
    members = found.join(texts, found["node"] == texts["cls"]).select("cls", "root", "n", "docs", "whole", F.col("top.key").alias("key"))
    parts = F.floor(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)) + 1
    members = members.join(members.groupBy("root").agg(parts.cast("int").alias("parts")), "root")
    members = materialise(members.withColumn("part", F.pmod(F.xxhash64("whole"), "parts").cast("int")).drop("whole", "n"), "members")
    moved = docs.select("key", "text").join(broadcast_if_small(members), "key")
    moved = moved.withColumn("pair", F.explode(_pairs(F.col("part")))).select("root", "pair.i", "pair.j", "cls", "docs", "part", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            cls, at = np.unique(group.column("cls").to_numpy(), return_index=True)  # rows may repeat
            group = group.take(at)
            docs_of, side = group.column("docs").to_numpy(), group.column("part").to_numpy()
            values, first = shingles(Words(group.column("text"), shingle), shingle, exact=True)
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            forest, n = Forest(len(cls)), np.zeros(len(cls), np.int64)
            for a, b in links(Sets(values, first), threshold, np.flatnonzero(side == i), np.flatnonzero(side == j)):
                np.add.at(n, a, docs_of[b])
                np.add.at(n, b, docs_of[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(x, y)
            known: dict[bytes, int] = {}
            same = [known.setdefault(values[a:b].tobytes(), k) for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), cls.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(cls[forest.roots(np.arange(len(cls)))]), pa.array(n), pa.array(same if i == j else [None] * len(cls), pa.int64())], ["cls", "up", "links", "same"])

    verified = materialise(moved.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "cls long, up long, links long, same long"), "verified")
    counts = verified.groupBy("cls").agg(F.sum("links").alias("links"), F.min("up").alias("up"), F.min("same").alias("same"))
    if members.agg(F.max("parts")).first()[0] not in (None, 1):  # a group that lies in several tasks
        roots = components(verified.select(F.col("cls").alias("a"), F.col("up").alias("b")))
        counts = counts.drop("up").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "links", F.coalesce("root", "cls").alias("up"), "same")
    of = texts.select("cls", "seq", "top", "docs").join(counts, "cls", "left").withColumn("up", F.coalesce("up", "cls")).withColumn("same", F.coalesce("same", "cls"))
    best = of.groupBy("up").agg(F.max("top").alias("best"))
    sets = of.groupBy("same").agg(F.max("top.doc_id").alias("class_id"))
    of = of.join(best, "up").join(sets, "same").select("seq", "class_id", F.col("best.doc_id").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), F.col("best.key").alias("stays"))
    of = materialise(of, "linked")
    for spent in (texts, found, members, verified):
        discard(spent)
    some = signed.filter("seq IS NOT NULL").select("doc_id", "key", "seq").join(of, "seq")
    some = some.select("doc_id", "key", "class_id", "group_id", "n_links", (F.col("key") == F.col("stays")).alias("kept"))
    none = signed.filter("seq IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def _pairs(part: Column) -> Column:
    """All pairs (i, j), i <= j, of a row's own part and each of the parts 0 to parts - 1."""
    return F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d WHERE len(w) > 0
), cls AS (
  SELECT r, md5(string_agg(g, chr(1) ORDER BY g)) AS c, count(*) AS n FROM s GROUP BY r
), k AS (
  SELECT c, max(doc_id) AS class_id, count(*) AS docs, min(r) AS r, min(n) AS n FROM cls JOIN d USING (r) GROUP BY c
), one AS (
  SELECT c, g, n FROM k JOIN s USING (r)
), link AS (
  SELECT a.c AS a, b.c AS b FROM one a JOIN one b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6
), reach AS (
  SELECT c AS a, c AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), grp AS (
  SELECT reach.a AS c, max(k.class_id) AS group_id FROM reach JOIN k ON k.c = reach.b GROUP BY reach.a
), n AS (
  SELECT link.a AS c, sum(k.docs) AS links FROM link JOIN k ON k.c = link.b GROUP BY link.a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(group_id, doc_id) AS group_id, CAST(coalesce(links, 0) + coalesce(docs, 1) - 1 AS BIGINT) AS n_links, doc_id = coalesce(group_id, doc_id) AS kept
FROM d LEFT JOIN cls USING (r) LEFT JOIN k USING (c) LEFT JOIN grp USING (c) LEFT JOIN n USING (c)
"""
