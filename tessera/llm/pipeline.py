"""The corpus pipeline: toxicity, line deduplication, near duplicates, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, n_chars counted anew.

Rows are judged each by itself, whatever their doc_id: null and repeated ones are given numbers of their own, and a row
given twice is two documents with one text, of which the later one loses its lines and the n-gram stage keeps one. Texts
without words link with nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, ngram_join, sentencepiece_bpe, toxicity
from tessera.sources.stage import staged


ROW = "row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of each row's own that ascends with doc_id (null ones last). That is doc_id itself where no
    row shares it or has none; else the rows are sorted, numbered and staged, so that every reader sees the same numbers."""
    key = F.col("doc_id").cast("long")
    if docs.select(key.alias(ROW)).groupBy(ROW).count().where(f"{ROW} is null or count > 1").isEmpty():
        return docs.withColumn(ROW, key)
    return staged(docs.orderBy(key.asc_nulls_last(), F.xxhash64("text")).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _numbered(rows: DataFrame) -> DataFrame:
    """What an operator is given: the row's number as its doc_id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _where(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return rows.join(found.select(F.col("doc_id").alias(ROW)), ROW, how).drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or nearly equal line go; a document that loses all its words goes with them."""
    rows = _keyed(docs).withColumnRenamed("doc_id", "own_id").withColumnRenamed(ROW, "doc_id")
    out = line_dedup.dedup(rows).where(r"n_removed = 0 or text rlike '\\S'").drop("doc_id").withColumnRenamed("own_id", "doc_id")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, that of the smallest doc_id (null only where no other has one)."""
    rows = _keyed(docs)
    return _where(rows, ngram_join.join(_numbered(rows)).where("doc_id = component_id"), "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    rows = _keyed(docs)
    found = decontaminate.contamination(_numbered(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _where(rows, found.where("contaminated"), "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of its tokens. Workers that have served the other stages get smaller caches."""
    import public_tokenizers

    return sentencepiece_bpe.token_digests(docs, sentencepiece_bpe.model_bytes(public_tokenizers.path("piece_bpe_32k.model")), 50_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
