"""From raw documents to a training mix: five stages, each by one operator, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.decontamination import contaminated
from furrow.llm.frames import fold, remove, row_key, shared_folder, stored, table
from furrow.llm.language_id import UNKNOWN, identify, learn
from furrow.llm.near_copies import few, near_copy_groups
from furrow.llm.source_mix import mix
from furrow.llm.substring_dedup import substring_dedup

#: A document stays if its language is at least this probable.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or that no language fits better than all others together, go."""
    model = learn(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    told = identify(docs, model)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key, and the key's name, which no column of docs has."""
    name = "_key"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return docs.withColumn(name, row_key()), name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): that with the smallest doc_id. Rows without one are told apart by their text
    and come after all others; of rows that repeat a doc_id that with the smallest text stays, null first, then by the columns that can be ordered.

    Texts are moved only where the lists of keys to drop are too long to be broadcast, and for repeated ids."""
    keyed, key = _keyed(docs)
    groups = stored(near_copy_groups(keyed.select(F.col(key).alias("doc_id"), "text")))
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    repeated = few(stored(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).count().filter("count > 1").select(key)))
    kept = keyed.join(few(gone), key, "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    order = ["text", *(c for c, kind in docs.dtypes if c != "text" and not kind.startswith(("map", "variant")) and "map<" not in kind)]
    one = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row")).select("row.*")
    return kept.join(repeated, key, "left_anti").select(docs.columns).union(one)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat an earlier passage; those of which nothing is left go. n_chars follows the text."""
    keyed, key = _keyed(docs)
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row")
    kept = substring_dedup(keyed.select(F.col(key).alias("doc_id"), "text", rest), with_text=True, carry=("row",)) \
        .filter("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select([new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    keyed, key = _keyed(docs)
    found = stored(contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(few(found), key, "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, taken (words, repeats counted); documents not taken go."""
    return mix(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", decontaminate), ("source_mix", source_mix),
]

#: SQL has neither the fitted language model nor the fingerprints; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
