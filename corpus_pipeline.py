"""From raw documents to packed sequences: each stage is written as Parquet and read again by the next.

Every stage but the last returns whole rows of its input. Rows are judged one by one,
so a null or repeated doc_id, repeated rows and further columns change nothing: toxicity
and decontamination read a row and keep it or not, and the two stages that compare rows
give each a number of its own. Null texts count as empty ones, an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.llm import toxicity as toxic
from plexora.llm.common import collect_garbage, keyed, rows_without, stored
from plexora.llm.decontaminate import without_contaminated
from plexora.llm.ngram_join import ngram_jaccard
from plexora.llm.packing import pack
from plexora.llm.quality_rules import quality_rules
from plexora.llm.tokens import public_path


def _numbered(rows: DataFrame) -> DataFrame:
    """Keyed rows with their number in place of doc_id."""
    return rows.withColumn("doc_id", F.col("_row"))


def _light(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun when executors have given back what the work before it has left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


@_light
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows that fail the base rules (null, empty and short texts do) or are outliers of their language and source."""
    rows = keyed(docs)
    return rows_without(rows, quality_rules(_numbered(rows)).where("not kept").select("doc_id"))


@_light
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows that score 0.7 or more. The model is learned from the labelled rows among all documents."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxic.without_toxic(docs, toxic.fit(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.7)


@_light
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows linked at Jaccard 0.8 on five-word shingles one row stays, the first of the table.

    Copies are linked, so of a repeated row one stays; rows without words are linked with nothing and stay.
    """
    rows = keyed(docs)
    return rows_without(rows, ngram_jaccard(_numbered(rows), 5, 80).where("doc_id <> component_id").select("doc_id"))


@_light
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out rows that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_light
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 2048 tokens."""
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The toxicity model and the packing can't be expressed in SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
