"""From raw documents to token ids: quality filter, near-duplicate removal, repeat removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. Extra columns are carried
through all stages but the last, whatever their names. An empty table gives an
empty one. Very long texts are worked on whole. What a stage does with nulls,
ties and repeated rows is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._rounds import plain_names, removed, stored
from quire.llm.bpe import bpe
from quire.llm.decontaminate import without_contaminated
from quire.llm.jaccard_join import jaccard_join
from quire.llm.quality_classifier import fit, score
from quire.llm.queries import VOCABULARY
from quire.llm.suffix_dedup import without_repeats

QUALITY_THRESHOLD = 0.7
_SCORE = "__quality_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have one and the same score and go or stay by it. Repeated rows are judged
    alike; a score that equals the threshold is kept. Labels are not inputs of a score.
    """
    plain = plain_names(docs, ("doc_id", "text"))
    model = fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(plain, model, to=_SCORE).where(F.col(_SCORE) >= QUALITY_THRESHOLD).drop(_SCORE).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links connect, the document of least doc_id.

    Rows that share a doc_id are one document and go or stay together. Rows without a doc_id stay, as do
    documents without words. Of equal texts the least doc_id stays.
    """
    plain = plain_names(docs, ("doc_id", "text"))
    found = jaccard_join(plain)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return plain.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that one of smaller doc_id has; those that lose everything go.

    Whole characters are cut. Rows that share a doc_id, or have none, are one document and lose nothing to
    each other; those without come last. A null text stays null, an empty one empty.
    """
    return without_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Rows are judged each, with or without a doc_id; null and empty texts stay. An empty benchmark removes nothing.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text.

    A row for each row, with or without a doc_id; null and empty texts have no tokens.
    """
    found = bpe(docs, VOCABULARY)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("repeats", repeats), ("contamination", contamination), ("encoding", encode)]

#: A trained model and a tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again, and then those of the stage before are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
