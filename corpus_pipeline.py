"""From raw documents to tokens: toxicity, exact and near duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last
return the columns of ``docs`` as they came, whatever their names; the last returns tokens.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm import bpe, decontaminate, grace, jaccard, toxicity
from tastemap.llm.common import ascii_lower, fresh, row_key, table, written

#: A document goes from this toxicity score on.
TOXIC = 0.7
FOLDS, HELD = 3, 1
#: Near copies share this percentage of their distinct shingles of so many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def _semi(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` with (or without) a row of ``keys`` that agrees in all its columns; nulls agree."""
    names = {c: fresh(docs, f"right_{c}") for c in keys.columns}
    right = keys.withColumnsRenamed(names)
    on = F.lit(True)
    for c, n in names.items():
        on = on & docs[c].eqNullSafe(right[n])
    return docs.join(right, on, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``TOXIC``; null and empty texts are judged by the bias."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", FOLDS, HELD)
    name = fresh(docs, "toxicity")
    return toxicity.score(docs, model, keep=docs.columns, name=name).filter(F.col(name) < TOXIC).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows that share that id and the text, one."""
    found = written(grace.exact_groups(docs))
    name = fresh(docs, "text_sha256")
    keys = lambda df: df.select("doc_id", F.col("text_sha256").alias(name))
    keyed = docs.withColumn(name, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    out = _semi(keyed, keys(found.filter("kept")))
    twice = written(keys(found.groupBy("doc_id", "text_sha256").count().filter("count > 1")))
    if not twice.isEmpty():
        out = _semi(out, twice, "left_anti").union(_semi(out, twice).dropDuplicates(["doc_id", name]))
    return out.drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, of smallest id; rows without id or shingles stay.

    Rows that repeat an id are rows of their own, which stay or go by their own text.
    """
    found = jaccard.near_duplicates(docs, percent=NEAR_PERCENT, size=NEAR_WORDS, by_row=True)
    found = written(found.filter("component is not null").select("doc_id", "k", "component"))
    firsts = found.groupBy("component").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.filter("n > 1").select("component", "first.k"))
    name = fresh(docs, "row_key")
    several = found.join(firsts.select("component"), "component", "left_semi")
    gone = written(several.join(firsts.select("k"), "k", "left_anti").select(F.col("k").alias(name)).distinct())
    out = _semi(docs.withColumn(name, row_key()), gone, "left_anti")
    # Rows equal in id and text share their key.
    twice = written(several.join(firsts.select("k"), "k", "left_semi").groupBy("k").count().filter("count > 1").select(F.col("k").alias(name)))
    if not twice.isEmpty():
        out = _semi(out, twice, "left_anti").union(_semi(out, twice).dropDuplicates([name]))
    return out.drop(name)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    name = fresh(docs, "row_key")
    hit = written(found.filter("n_hit > 0").select(F.col("k").alias(name)).distinct())
    return _semi(docs.withColumn(name, row_key()), hit, "left_anti").drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of every document, with digests of ids and decoded text."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe_tokens", encode),
]

#: The trained classifier and the tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
