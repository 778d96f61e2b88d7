"""A corpus from documents to token ids: filter, clean, deduplicate, mix, encode."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.line_dedup import dedup_lines
from logweir.llm.mixing import mix, taken_rows
from logweir.llm.pieces import encode, load_pieces
from logweir.llm.quality import keep_good
from logweir.llm.shingle_join import one_of_each
from logweir.llm.text import table
from logweir.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in one; a null text stays null."""
    kept = dedup_lines(docs).withColumn("text", F.when(F.col("row.text").isNotNull(), F.col("kept_text")))
    fresh = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one cut by a quota gives the words taken."""
    taken = taken_rows(mix(docs))
    return taken.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, text, ids``: the ids of each text's pieces."""
    return encode(docs, load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Learned rules, MinHash and seeded choices have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each writes Parquet to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
