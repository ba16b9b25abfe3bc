"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality rules -> line dedup -> n-gram Jaccard join (one document of each class stays) -> mixing sources -> BPE.
All stages but the last return the columns of ``documents``; the last returns a row of ids for each row of the mix.

Defined results, for every stage: an empty table gives an empty table; columns beyond those of ``documents``, whatever their names,
pass through all stages but the last untouched. By stage:

* quality rules: a null or empty text goes, as it has under 50 words; repeated rows are judged alike; a null id or source is kept.
* line dedup: a null text stays null; rows that share a doc_id are one document; rows with a null id are one, after all others; equal
  lines of one document stay, so do ties between them.
* near duplicates: texts without words stay; of a class the row of the smallest id stays, rows that repeat its id and its words too; a
  class without ids keeps one row.
* mixing: a null source is a source; a text without words is taken 0 times and goes; of rows that tie as many are taken as fit.
* BPE: a null or empty text has no ids; a null id stays null; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, linededup, mixing, quality, setjoin
from tidemark.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them."""
    return linededup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five words, a similarity of 0.8 or more."""
    return setjoin.keep_representatives(docs, setjoin.Rule(5, 80, 100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and ids (little-endian unsigned 32-bit integers)."""
    return bpe.encode(docs).select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokenize", tokenize),
]

#: SQL has no likelihood ratio over hashed n-grams and no BPE; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
