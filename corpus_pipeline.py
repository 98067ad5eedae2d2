"""From raw documents to a training mixture: five stages, each over all that the one before it kept.

1 language ID: documents of no learned language go (null, without a letter, or of unknown n-grams); a null label is filled;
2 line dedup: lines that repeat an earlier one go, and documents that this leaves without words;
3 SimHash near-dedup: one document of each group stays, that of the least id;
4 benchmark decontamination: documents that hold a benchmark item go;
5 mixing: sources are given the weights of a temperature, a row for each pass in which a document stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from melodex.llm import decontaminate, language_id, line_dedup, mixing, simhash
from melodex.llm.common import fold, fresh, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents as op10 does; null texts, texts without a letter and those in no learned language go. What
    is in none is said by each language's own kept-out rows; of a rare label nothing goes."""
    model = language_id.train(docs.where(fold(docs["doc_id"], 4) != 2))
    return language_id.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ``pass`` (with underscores in front where documents have it); with the least budget that
    shows every document once, so none is lost."""
    made = mixing.mix(docs)
    pass_ = made.columns[len(docs.columns) + 2]
    return made.select(*docs.columns, made[pass_].alias(fresh(docs, "pass")[0]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]
#: A trained classifier, edit distances and hashed fingerprints are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
