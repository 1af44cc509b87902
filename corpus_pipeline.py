"""Documents to packed training sequences: filter, deduplicate, redact and pack.

All stages keep the columns they get, whatever they are called, and take null and empty texts, null ids and
repeated rows: a text that is null counts as empty where it is judged and stays null where it is kept. Repeated
rows are judged alike, and near-duplicates keeps one of them. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm import bpe, packing, pii, quality_model, quality_rules, simhash
from passagekit.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the documents has it."""
    while name in docs.columns:
        name += "_"
    return name


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against those labelled good.

    Null and empty texts have too few words and go.
    """
    name = _free(docs, "_judged")
    judged = quality_rules.with_verdict(docs, quality_rules.trusted(spark, sf_dir), out_col=name)
    return judged.where(f"{name}.kept").select(*docs.columns)


def keep_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good.

    It learns from all labelled documents, since few bad ones are left among ``docs``. Equal texts
    have equal scores; without labels every document stays.
    """
    labels, examples = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    name = _free(docs, "_score")
    scored = quality_model.with_score(docs, labels, out_col=name, examples=examples)
    return scored.where(F.col(name) >= quality_model.CUT).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Repeated rows of that document become one. Documents without an id can't be named as
    the copy of another one and stay, equal texts as one.
    """
    groups = simhash.near_duplicates(docs, words_per_shingle=3, max_bits=2)
    first, place, times = (_free(docs, name) for name in ("_first", "_place", "_times"))
    firsts = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(first)).agg(F.count(F.lit(1)).alias(times))
    # Rows go by id, those without one by text. Both branches filter after the join, so that they read the same
    # shuffle of the texts; hash tables hold ids only, and only texts that may be repeated rows are sorted.
    placed = docs.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    joined = placed.join(firsts.hint("shuffle_hash"), F.col(place) == F.col(first), "left")
    single = joined.where(F.col(times) + F.col("doc_id").isNull().cast("long") == 1)
    repeated = joined.where(F.col("doc_id").isNull() | (F.col(times) > 1)).dropDuplicates([place, "doc_id", "text"])
    return single.union(repeated).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; ``n_chars`` follows the text and is null with it. No row goes."""
    done = pii.with_surrogates(docs, count_col=_free(docs, "_entities"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is one piece of its end token."""
    return packing.packed(docs, bpe.vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_model),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("pii", replace_personal_data),
    ("best_fit_packing", pack),
]

#: Its stages are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
