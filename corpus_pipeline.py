"""From raw documents to token ids: language ID, exact dedup, near dedup, benchmark decontamination, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next one works on. run() applies them
to the table documents, each stage's rows written as Parquet and read again.

Any column may be null, texts may be empty or of any length, rows may repeat, documents may have other columns (which stay until the
last stage), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import byte_bpe, decontamination, exact_dedup, language_id, near_dedup
from orbweave.session import discard, materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects a text without a letter, null and empty ones among them; the prototypes are those of docs' own languages.
    Which language a text has, and how surely, decides nothing: the rows kept are those of the letter test that stands in
    where no labelled text has a letter."""
    prototypes = language_id.learn(docs)
    if not any(v.any() for v in prototypes.values()):
        return docs.filter(r"text RLIKE '\\p{L}'")
    return language_id.predict(docs, prototypes, to="_ow_lang", score="_ow_score").filter("_ow_lang <> 'und'").drop("_ow_lang", "_ow_score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it too, one."""
    return exact_dedup.kept_rows(docs)


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group that links of similarity 0.8 or more hold together, the row with the largest doc_id stays."""
    return near_dedup.kept_rows(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, benchmark, to="_ow_hits").filter("size(_ow_hits) = 0").drop("_ow_hits")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: each text encoded, and decoded again."""
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [
    ("language ID", identified),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", not_near),
    ("benchmark decontamination", unseen),
    ("byte-level BPE", encoded),
]

#: The stages can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # nothing reads the rows that a stage has worked on again
    return STAGES[-1][1](spark, docs, sf_dir)
