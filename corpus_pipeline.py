"""The corpus pipeline: language ID, quality, near-duplicates, mixing, packing.

Each stage gets the documents that the stage before it kept, as a Parquet table, and the folder of the test tables.
All stages but the last return the columns of documents, and further columns that the documents have. Every stage gives
no rows for no documents. Ties are settled by id; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, minmax_dedup, mixing, packing, quality
from ledgerloom.llm.common import written

#: Documents whose quality score is below this go. Far under the 0.7 of a sure prediction, so that clean ones stay.
LEAST_QUALITY = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter, whose language can't be told, go; lang becomes the predicted language.

    Null and empty texts go. Repeated rows stay, each. A null id, source or lang changes nothing; without any labelled
    text all documents are `und` and go.
    """
    net = language_id.train(docs)
    told = language_id.predict(docs, net, pred="_pred", score="_score").where("_pred <> 'und'")
    return told.withColumn("lang", F.col("_pred")).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a low quality score go.

    The score is the probability of label 1 if both labels were equally common. The cut lies far below the 0.7 of the
    operator's own decision, as a filter should keep clean documents: what it lets go are texts that the dictionary of
    bad text explains much better. Null and empty texts get the score of no bytes. Repeated rows share a score, null
    ids are scored too; without labels of both classes all documents stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="_score", predicted="_predicted").where(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Null texts and texts without words are groups of their own. Of repeated rows of one id one stays; rows without an
    id all stay, as nothing names them.
    """
    return minmax_dedup.drop_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times.

    Rows with the same id, source and size share a decision. Null is a source of its own; null texts have size 0.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens.

    Null text counts as empty, which still has its end. Repeated rows, and copies that the mix made, are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: No SQL: the stages' models and signatures have none. tests/llm compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
