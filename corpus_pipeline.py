"""A training corpus from ``documents`` in five stages; every stage works on all that its predecessor kept.

The language stage decides every row where it is read. The two stages after it first write the rows with a key that no other row
has, and ask the operator about that one. So rows that share a doc_id, or have none, are kept or dropped each for its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.llm.decontaminate import contaminated
from mediacast.llm.language import familiar
from mediacast.llm.mixing import mixed
from mediacast.llm.ngram_join import near_duplicates
from mediacast.llm.secrets import masked
from mediacast.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once with a key each, and the name of that column."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def _without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """The rows whose key is not in ``dropped``, which is written first: while it is small, Spark sees that and moves no text."""
    return rows.join(stage(dropped, "dropped"), row, "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that no learned language explains, by the length of their code, and texts without a letter."""
    return familiar(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the smallest doc_id, rows without one last."""
    rows, row = _keyed(docs)
    groups = near_duplicates(rows, key=row).select(row, "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row)))
    kept = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(first[row].alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = _keyed(docs)
    return _without(rows, contaminated(rows, benchmark, key=row).select(row).distinct(), row).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; ``n_chars`` follows the masked text."""
    hidden = masked(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with these numbers."""
    return mixed(docs).withColumn("target", F.round("target", 4)).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("source_mix", source_mix),
]

# The first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
