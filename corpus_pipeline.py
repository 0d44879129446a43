"""The corpus pipeline: documents through five of the operators, each stage written as Parquet and read again.

All stages take documents with the columns of COLUMNS and leave others out, whatever their names. A null text is an empty
one and is rejected by the first stage; null ids stay null, and rows are told apart by id and text together. Rows that are
equal in both are one document: the second stage keeps one of them. lang, source and n_chars may be null. Texts of any
length are read whole. Empty tables give empty results with the same columns."""


from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmend.llm import decontaminate, quality_rules
from textmend.llm.exchange import shared_folder
from textmend.llm.ngram_jaccard import ngram_jaccard_join
from textmend.llm.packing import pack
from textmend.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Without labels of quality 1 no text is scored and the base rules alone decide."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratio = quality_rules.fit(docs, labels.where("quality = 1").select("doc_id"))
    return quality_rules.quality_rules(docs, ratio).where("kept").select(*COLUMNS)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that rows names by doc_id and text_hash."""
    gone = rows.select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows repeated as they are one stays. A document without an id
    goes if another of its component has one; ties can't occur, as equal ids with other texts count each for themselves."""
    left = without(docs, ngram_jaccard_join(docs).where("doc_id is null and component_id is not null or doc_id <> component_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))
    return left.withColumn("place", first).where("place = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur elsewhere too; those left empty by that go. The rest keep
    their lines."""
    cut = substring_dedup(docs).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("n_words").alias("had"), "n_removed", "kept")
    cut = cut.dropDuplicates(["cut_id", "cut_hash"])
    out = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_hash")), "left").where("n_removed is null or n_removed < had")
    text = F.coalesce("kept", "text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; all of them if it's empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.decontaminate(docs, items).where("contaminated")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens; documents without a source share a queue."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark), ("packing", packed)]

#: SQL can't express the quality rules' model or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each writes lies in the shared folder until the session ends."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return docs
