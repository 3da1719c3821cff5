"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of DIM signs. A trigram's vector binds its letters: the product of the first
letter's vector rotated by two places, the second's rotated by one, and the third's. A text's vector bundles (sums) the
vectors of its trigrams, a language's prototype those of all its training texts, and a text has the language whose
prototype has the largest cosine with its own vector. Texts are lower-cased, and a run of other characters
than letters counts as one space. Vectors come from the letter's code point, so no table is learned or shipped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, mix64, table

DIM = 1024
#: A label column with more values is refused: prototypes are held by the driver and every task.
MOST_LANGUAGES = 5000
#: Bytes of text, trigrams, and numbers that are handled at once.
BLOCK, COLUMNS, CELLS = 1_000_000, 8192, 2_000_000


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A vector of DIM signs for each code point (0: the space)."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    bits = mix64(mix64(points.astype(np.uint64)[:, None] + np.uint64(0x51ED27)) + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


class Trigrams:
    """The trigrams of a block of texts: for each occurrence its text and its column; columns' vectors on demand."""

    def __init__(self, texts: list[str]) -> None:
        padded = [f" {t.lower()} " for t in texts]
        size = np.fromiter(map(len, padded), np.int64, len(padded))
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[points]
        first = np.zeros(len(points), bool)
        first[np.cumsum(size) - size] = True
        keep = letter | first
        keep[1:] |= letter[:-1]
        of = np.repeat(np.arange(len(texts)), size)[keep]
        symbols = np.where(letter, points, 0)[keep]
        self.letters = np.bincount(np.repeat(np.arange(len(texts)), size)[letter], minlength=len(texts))
        seen = np.zeros(0x110000, bool)
        seen[symbols] = True
        self.alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.int32)
        number[self.alphabet] = np.arange(len(self.alphabet))
        k, x = len(self.alphabet), number[symbols].astype(np.int64)
        same = of[2:] == of[:-2]
        code = ((x[:-2] * k + x[1:-1]) * k + x[2:])[same]
        self.of = of[2:][same]
        if k**3 <= 4 * CELLS:
            there = np.zeros(k**3, bool)
            there[code] = True
            self.codes = np.flatnonzero(there)
            rank = np.zeros(k**3, np.int32)
            rank[self.codes] = np.arange(len(self.codes))
            self.column = rank[code]
        else:
            self.codes, self.column = np.unique(code, return_inverse=True)

    def vectors(self, columns: slice) -> np.ndarray:
        k, codes, own = len(self.alphabet), self.codes[columns], letter_vectors(self.alphabet)
        a, b, c = codes // (k * k), codes // k % k, codes % k
        return (np.roll(own, 2, axis=1)[a] * np.roll(own, 1, axis=1)[b] * own[c]).astype(np.float32)

    def bundles(self, group: np.ndarray, n: int) -> np.ndarray:
        """For each of n groups of texts the sum of its trigrams' vectors; group: of each text, -1 for none."""
        out = np.zeros((n, DIM), np.float64)
        if not len(self.of):
            return out
        width = len(self.codes)
        step = max(1, CELLS // min(width, COLUMNS))
        mine = group[self.of]
        order = np.argsort(mine, kind="stable") if np.any(mine[1:] < mine[:-1]) else slice(None)
        mine, column = mine[order], self.column[order]
        for left in range(0, width, COLUMNS):
            right = min(width, left + COLUMNS)
            v = self.vectors(slice(left, right))
            for low in range(0, n, step):
                high = min(n, low + step)
                a, b = np.searchsorted(mine, (low, high))
                at, of = column[a:b], mine[a:b]
                if right - left < width:
                    inside = (at >= left) & (at < right)
                    at, of = at[inside], of[inside]
                counts = np.bincount((of - low) * (right - left) + (at - left), minlength=(high - low) * (right - left))
                out[low:high] += counts.reshape(high - low, right - left).astype(np.float32) @ v
        return out


def _texts(block: pa.RecordBatch) -> list[str]:
    return [t or "" for t in block.column("text").to_pylist()]


def learn(df: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """The prototype of each non-null value of lang. Each task sends one sum for each language, whatever it has read; a column of more than
    MOST_LANGUAGES values is an error."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches, "text", BLOCK):
            values, group = np.unique(np.array(block.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for value, row in zip(values.tolist(), Trigrams(_texts(block)).bundles(group, len(values)), strict=True):
                sums[value] = sums.get(value, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.rint(v).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    out: dict[str, np.ndarray] = {}
    for n, r in enumerate(parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).toLocalIterator()):  # DIM numbers a language
        if n >= DIM * MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang} a language?")
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    return out


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with two more columns: the language and its cosine (0 to 1; a negative one counts as 0).

    A text that is null, empty or without a letter is `und` with score 0, and so is all if nothing was learned. Of equal
    cosines the first language in alphabetical order wins. Whole texts are read, of any length, a block at a time; rows
    that repeat get equal results, and an empty table gives an empty one. Other columns stay as they are; columns called
    `to` or `score` are replaced.
    """
    names = sorted(k for k, v in prototypes.items() if np.any(v))
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), DIM)
    bounded_batches(df.sparkSession)
    own = f"_ow_text_{text}"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, own, BLOCK):
            texts = [t or "" for t in block.column(own).to_pylist()]
            found = Trigrams(texts)
            n, langs, scores = len(texts), np.full(len(texts), "und", object), np.zeros(len(texts))
            if names:
                v = found.bundles(np.arange(n), n)
                cosine = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                some = found.letters > 0
                langs[some] = np.array(names, object)[cosine.argmax(axis=1)][some]
                scores[some] = np.round(cosine.max(axis=1).clip(0, 1), 6)[some]
            rest = [c for c, k in zip(block.columns, block.schema.names, strict=True) if k != own]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(k for k in block.schema.names if k != own), to, score])

    rest = [(c, t) for c, t in df.dtypes if c not in (to, score)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rest), f"`{to}` string", f"`{score}` double"])
    return df.select(*(F.col(f"`{c}`") for c, _ in rest), F.col(text).alias(own)).mapInArrow(judge, schema)


def fold(doc_id: str, n: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.filter(fold("doc_id", 3) != 1))
    return predict(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), prototypes).drop("text")
