"""Quality scores by positive-unlabelled learning.

A linear scorer is fitted to trusted positives (rows labelled 1) and unlabelled text. With the class prior p the unbiased risk of a
scorer is p * R(positives, as 1) + [R(unlabelled, as 0) - p * R(positives, as 0)]; the bracket stands for negatives that nobody
has labelled, can't be negative, and is held at 0 from below (the non-negative risk). No row labelled 0 is ever read: the
prior is estimated from positives and unlabelled text too, as the least share that the scores of unlabelled text leave for
positives above any threshold.

The loss is the squared one, so the risk and its gradient depend on the rows through their sums of products alone. These are
taken over all unlabelled text of the learning fold, in whole numbers, so that neither the order nor the number of tasks matters; nothing of
it is sampled. Only the trusted positives are bounded, by SAMPLE.

Features: the frequencies of trigrams of byte classes (case, digits, blanks, line ends, marks, symbols), those of hashed words and
word pairs, how often a word repeats its neighbour, the share of different words, and the lengths of words and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import blocks, bounded_batches, mix64, span_hashes, table, utf8

#: The most positives that are fitted; beyond that, those of the least hashed ids.
SAMPLE = 8_000
#: Steps of the fit, and their length.
STEPS, RATE = 300, 0.1
CLASSES, HASHED = 8, 256
FEATURES = CLASSES**3 + HASHED + 5
#: Features are multiples of 1 / UNIT, rows are measured ROWS at a time, and sums are added FAN tasks' at a time.
UNIT, ROWS, FAN = 1024, 2000, 16
#: Bins of scores from -LIMIT to LIMIT.
BINS, LIMIT = 4096, 3.0


def _classes() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    out[128:] = 0
    for k, some in enumerate([range(97, 123), range(65, 91), range(48, 58), [32], [*range(9, 14)], b".,;:", b"!?"]):
        out[list(some)] = k
    return out


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each whole text, multiples of 1 / UNIT from 0 to 4; those of an empty text are 0."""
    data, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    kind = _classes()[data]
    of = np.repeat(np.arange(n), size)
    if len(data) > 2:
        code = (kind[:-2].astype(np.int64) * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        same = of[:-2] == of[2:]
        counts = np.bincount(of[2:][same] * CLASSES**3 + code[same], minlength=n * CLASSES**3).reshape(n, -1)
        out[:, : CLASSES**3] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1))[:, None])
    word = (kind != 3) & (kind != 4)
    new = np.zeros(len(data), bool)
    new[offsets[:-1][size > 0]] = True
    begin = np.flatnonzero(word & (new | np.append(True, ~word[:-1])[: len(data)]))
    stop = np.flatnonzero(word & np.append(~word[1:] | new[1:], True)[: len(data)]) + 1
    h, own = span_hashes(data, begin, stop), of[begin]
    words = np.bincount(own, minlength=n)
    some, hashed = np.maximum(1, words), np.zeros((n, HASHED), np.int64)
    again = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1]))
    order = np.lexsort((h, own))
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1]))[: len(h)]
    for bucket, text_of in ((h, own), (mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[own[1:] == own[:-1]], own[1:][own[1:] == own[:-1]])):
        hashed += np.bincount(text_of * HASHED + (bucket % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, -1)
    out[:, CLASSES**3 : CLASSES**3 + HASHED] = np.sqrt(hashed / np.maximum(1, hashed.sum(axis=1))[:, None])
    out[:, -5] = np.bincount(own[again], minlength=n) / some
    out[:, -4] = np.bincount(own[order][first], minlength=n) / some
    out[:, -3] = np.log1p(words) / 10
    out[:, -2] = np.bincount(own, stop - begin, minlength=n) / some / 20
    out[:, -1] = (words > 0) * 1.0
    return np.rint(np.minimum(out, 4) * UNIT) / UNIT


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights for features, and a bias: a margin near 1 for positives and -1 for others, and the prior that it was fitted with."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float) -> None:
        self.weights, self.bias, self.prior = weights, bias, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1: the share (1 + margin) / 2, bent where it would leave these bounds, so that order is kept."""
        return _sigmoid(2 * self.margin(x))


class Moments:
    """The number of some rows, and their mean feature and mean product of features (a last feature is always 1)."""

    def __init__(self, sums: np.ndarray) -> None:
        self.n = int(sums[-1, -1])
        self.products = sums / max(1, self.n)

    def standard(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The mean products of (features - mean) / scale, with the constant last."""
        shift = np.diag(np.append(1 / scale, 1.0))
        shift[:-1, -1] = -mean / scale
        return shift @ self.products @ shift.T


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Of a scorer: the risk of positives as 1, times the prior; and what stands for the risk of negatives as 0, before it is held at 0."""
    mp, mu = positive[-1] @ w, unlabelled[-1] @ w
    sp, su = w @ positive @ w, w @ unlabelled @ w
    return prior * (1 - 2 * mp + sp) / 4, (1 + 2 * mu + su) / 4 - prior * (1 + 2 * mp + sp) / 4


def ridge(rows: int) -> float:
    """The ridge on standardised weights: less with more rows, down to a floor for features that say the same."""
    return max(0.002, 100 / max(100, rows))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """The weights (the constant's last) that minimise the non-negative risk and the ridge, given both sides' standardised mean products.

    Steps are gradients scaled by the inverse of unlabelled text's products; where the bracket is below 0 the step goes back up.
    """
    weight = ridge * np.append(np.ones(len(positive) - 1), 1e-6)
    scaled = np.linalg.inv(unlabelled / 2 + 2 * np.diag(weight))
    w = np.zeros(len(positive))
    for _ in range(STEPS):
        negative = (unlabelled[-1] + unlabelled @ w) / 2 - prior * (positive[-1] + positive @ w) / 2
        if risk(w, positive, unlabelled, prior)[1] >= 0:
            step = prior * (positive @ w - positive[-1]) / 2 + negative + 2 * weight * w
        else:
            step = -negative
        w = w - RATE * (scaled @ step)
    return w


def _model(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float) -> Model:
    return Model(w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum()), prior)


def separate(positive: Moments, unlabelled: Moments) -> Model:
    """The least-squares scorer of positives against unlabelled text, on the way to the prior."""
    mean, scale = _spread(unlabelled)
    p, u = positive.standard(mean, scale), unlabelled.standard(mean, scale)
    w = np.linalg.solve((p + u) / 2 + ridge(positive.n) * np.eye(len(p)), (p[-1] - u[-1]) / 2)
    return _model(w, mean, scale, 0.5)


def fit(positive: Moments, unlabelled: Moments, prior: float) -> Model:
    """The scorer of least non-negative risk. Without positives or unlabelled rows the score is the same for all."""
    if not positive.n or not unlabelled.n:
        return Model(np.zeros(FEATURES), 2 * prior - 1, prior)
    mean, scale = _spread(unlabelled)
    return _model(minimise(positive.standard(mean, scale), unlabelled.standard(mean, scale), prior, ridge(unlabelled.n)), mean, scale, prior)


def _spread(of: Moments) -> tuple[np.ndarray, np.ndarray]:
    mean = of.products[-1, :-1]
    return mean, np.sqrt(np.maximum(np.diag(of.products)[:-1] - mean**2, 0)) + 0.02


def mixture(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, from both sides' counts of scores by bin (the lowest first): the least ratio of the
    shares above a threshold, at the threshold where that ratio and its uncertainty are least. Between 0.01 and 0.99."""
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    p, u = np.cumsum(positive[::-1]) / n, np.cumsum(unlabelled[::-1]) / m
    doubt = np.sqrt(np.log(40) / 2 / n) + np.sqrt(np.log(40) / 2 / m)
    some = p > 0
    at = np.argmin((u[some] + doubt) / p[some])
    return float(np.clip(u[some][at] / p[some][at], 0.01, 0.99))


def _measured(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for block in blocks(batches, text):
        for low in range(0, block.num_rows, ROWS):
            part = block.slice(low, ROWS)
            yield part, features(part.column(text))


def moments(rows: DataFrame) -> Moments:
    """Over the column text of all rows. Tasks send sums of whole numbers, which are added FAN at a time until FAN are left for the driver."""
    upper = np.triu_indices(FEATURES + 1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 1))
        for _, x in _measured(batches):
            whole = np.append(np.rint(x * UNIT), np.full((len(x), 1), UNIT), axis=1).astype(np.float64)
            total += whole.T @ whole  # whole numbers far below 2^53: exact
        yield pa.RecordBatch.from_arrays([pa.array([total[upper].tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]))
        for batch in batches:
            for part in batch.column("sums"):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = materialise(rows.select("text").mapInArrow(product, "sums binary"), "moments")
    n = parts.count()
    while n > FAN:
        n = -(-n // FAN)
        before, parts = parts, materialise(parts.repartition(n).mapInArrow(add, "sums binary"), "moments")
        discard(before)
    total = np.zeros((FEATURES + 1, FEATURES + 1))
    total[upper] = sum((np.frombuffer(r["sums"]) for r in parts.collect()), np.zeros(len(upper[0])))  # FAN rows at most
    discard(parts)
    return Moments((total + np.triu(total, 1).T) / UNIT**2)


def histogram(rows: DataFrame, model: Model) -> np.ndarray:
    """How many of all rows have a margin in each of BINS bins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for _, x in _measured(batches):
            at = (np.clip(model.margin(x), -LIMIT, LIMIT) + LIMIT) / (2 * LIMIT) * (BINS - 1)
            total += np.bincount(np.rint(at).astype(np.int64), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in rows.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r["bin"]] = r["n"]
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit to the rows of docs that labels marks 1, `sample` ids at most, and to all rows of docs as unlabelled text. Other labels are not read.

    Null labels and ids are not learned from. The prior is estimated on one half of the positives with a scorer fitted to the other, and all are fitted in the end.
    """
    bounded_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit("sample"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).filter("doc_id IS NOT NULL AND y = 1").select("doc_id").distinct()
    trusted = marks.orderBy(order, "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    positive = materialise(rows.join(F.broadcast(trusted), "doc_id", "left_semi").select("text", F.pmod(order, F.lit(2)).alias("half")), "positive")  # `sample` ids
    halves = [moments(positive.filter(F.col("half") == k)) for k in (0, 1)]
    unlabelled = moments(rows)
    both = halves[0].n * halves[0].products + halves[1].n * halves[1].products
    scorer = separate(halves[0], unlabelled)
    prior = mixture(histogram(positive.filter("half = 1"), scorer), histogram(rows, scorer)) if halves[0].n else 0.5
    discard(positive)
    return fit(Moments(both), unlabelled, prior)


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with one more column: how likely label 1 is, from 0 to 1.

    A null text counts as empty, and an empty text has a score like any other. Whole texts are read, of any length; rows that
    repeat get equal scores, and an empty table gives an empty one. A column called `to` is replaced.
    """
    bounded_batches(df.sparkSession)
    own = "_ow_text"
    rows = df.drop(to).withColumn(own, F.col(text))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _measured(batches, own):
            rest = block.drop_columns([own])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.round(model.score(x), 6))], [*rest.schema.names, to])

    return rows.mapInArrow(judge, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != own), f"`{to}` double"]))


def fold(doc_id: str, n: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))
    scored = score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
