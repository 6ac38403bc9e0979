"""The corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import packing, passages, shingles, toxicity
from tickloom.llm.common import stored, table, utf8
from tickloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (score below 0.3). The model is fitted on labelled rows of ``docs`` that aren't held out."""
    columns = tuple(docs.columns)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    renamed = docs.select(F.col("doc_id").alias("_scored"), F.col("text").alias("_read"), *columns)
    return toxicity.score(renamed, model, id_col="_scored", text_col="_read", threshold=0.3, keep=columns).where("predicted = 0").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates. Texts of one id are told apart by a hash; of repeated rows one stays."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(shingles.NO_ID))
    keep = shingles.join(docs, versions=True).where("kept").select(number.alias("_number"), F.col("version").alias("_version")).distinct()
    own = docs.withColumn("_number", number).withColumn("_version", F.xxhash64(utf8("text")))
    # The join and the window share one exchange: a text is sent once.
    first = F.row_number().over(Window.partitionBy("_number", "_version").orderBy("_number"))
    return own.join(keep, ["_number", "_version"]).withColumn("_copy", first).where("_copy = 1").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that begin earlier as well. Only whole characters are removed, so that what is left is text; documents of which nothing is left go."""
    columns = tuple(docs.columns)
    return passages.without_repeats(docs, keep=columns).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), max_len=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
