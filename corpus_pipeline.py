"""The corpus pipeline: toxicity, quality, exact dedup, near-duplicate join and packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame,
which run() writes as Parquet in the shared folder and reads again. All but the last return the columns of
documents. The filters learn from labels as their operators do: the toxicity stage from documents outside
its held-out fifth, the quality stage from documents outside its held-out quarter. Both score documents
that no model has seen; a stage learns from the labelled documents that it is given.

Rows with a null doc_id pass the filters by their texts; in the dedup stages one survives only if its text
has no other copy with an id, and the near-duplicate stage, which names documents by id, drops none of them.
Repeated rows of one doc_id count as one document and stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timelode.llm import dedup_exact, ngram_join, packing, quality, toxicity
from timelode.llm._common import table, written

#: Scores at which documents are rejected: toxic from the first on, of poor quality below the second.
TOXIC_FROM, QUALITY_FROM = 0.5, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scored(docs, model) < TOXIC_FROM)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_FROM."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.scored(docs, model) >= QUALITY_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts."""
    return dedup_exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near-duplicates."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 1024 tokens."""
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]
#: The filters and the near-duplicate components are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
