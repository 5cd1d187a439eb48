"""documents -> token files: quality, near-dedup, decontamination, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm import decontaminate, factorisation, mixing, packing, shingles
from partmill.llm.common import few, shared_dir, table, written

LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts, with all their columns. Rows are judged by text and n_chars, nulls as empty; repeated rows alike; an empty table stays empty."""
    machine = factorisation.fitted(docs, table(spark, sf_dir, "labels"))
    return factorisation.accepted(docs, machine, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    A document is a doc_id with a text: rows equal in both stay or go together, other
    texts of the same doc_id are other documents. Of several texts of a group's
    smallest doc_id that of the least MD5 stays. Rows without doc_id stay; null and
    wordless texts are near-duplicates of each other. Extra columns are kept.
    """
    found = written(shingles.near_duplicates(docs.filter("doc_id is not null")))
    first = found.filter("doc_id = component_id")
    several = first.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most")
    rest = first.join(few(written(several)), "doc_id").filter("digest <> least")
    gone = written(found.filter("doc_id <> component_id").select("doc_id", "digest").unionByName(rest.select("doc_id", "digest")).distinct())
    own = docs.filter("doc_id is not null").alias("own")
    same = (F.col("own.doc_id") == F.col("gone.doc_id")) & (F.md5(F.coalesce("own.text", F.lit(""))) == F.col("gone.digest"))
    return own.join(few(gone).alias("gone"), same, "left_anti").select("own.*").unionByName(docs.filter("doc_id is null"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, with all their columns; null texts hold none, rows without doc_id are judged as others."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' weights, shuffled, with all their columns; a null source is '', a null doc_id draws as 'null', repeated rows come equally often."""
    return mixing.mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in an order that keeps copies apart, read back: doc_id, start, n_tokens, ids_crc32. A null text is the end id alone; an empty table gives no rows."""
    own = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))  # of the written table: a task that runs again numbers alike
    order = [F.xxhash64("doc_id", "__row"), F.col("__row")]
    return packing.packed(own, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark), 49_408, order=order)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", benchmark_free), ("mixing sources", mix), ("token-ID output", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
