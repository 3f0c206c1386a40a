"""A training corpus from raw documents: each stage works on what the stage before it kept.

    quality classifier -> line dedup -> MinHash near-dedup -> source mixing -> SentencePiece ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import table, written
from terralith.llm.kneser_ney import drop_low_quality, trusted_ids
from terralith.llm.line_dedup import line_dedup
from terralith.llm.minhash import drop_near_duplicates
from terralith.llm.mixing import poisson_mix
from terralith.llm.sentencepiece_viterbi import encode_column


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier doesn't reject."""
    return drop_low_quality(docs, trusted_ids(table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars follows the text. Documents of nothing else are copies that stand on
    many sites: they stay whole, and the next stage keeps one of them."""
    cut = line_dedup(docs, min_sites=5, keep_whole=True)
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 alike or more."""
    return drop_near_duplicates(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same share of as many rows: a document is repeated as often as drawn."""
    return poisson_mix(docs, seed="mix-1").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and token_ids of every document."""
    return encode_column(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: SQL can't train the classifier or run Viterbi. The tests compare lines, near_duplicates and mix with plain Python row by
#: row, the classifier's scores with the definition, quality by the labels, and tokens with the vocabulary's own library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage_{name}")
    return docs
