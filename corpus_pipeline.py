"""From raw documents to token ids: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, further ones
too, whatever their names. Rows without doc_id and rows that share one are documents like others at every stage. An empty
table gives an empty one. Ties are settled by what the rows hold, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut
from quern.llm.op01_bpe import encode, production_tokenizer
from quern.llm.op02_line_dedup import dedup_lines
from quern.llm.op03_minhash import dedup
from quern.llm.op08_mixing import mixed_documents
from quern.llm.op09_language import fit_on, identify


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without text or without a letter go.

    A text with a letter stays whatever its name, also where no model could be fitted and all are 'und'. Rows are judged
    one by one, so repeated ones alike.
    """
    named = identify(docs, fit_on(docs), keep_text=True)
    return named.filter((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts; a document of which no word is left goes.

    Earlier is by doc_id, nulls last, then by what the row holds. Rows that are equal in all columns are one document here
    and all stay, for near-dedup to choose among. A text without words that lost nothing stays, a null one too.
    """
    out = dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows that share it, one.

    Texts without words are alike to nothing and all stay.
    """
    return dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' target weights: some go, some are there twice. Texts without words go, a null source is one."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each document; a null text has none."""
    return encode(docs.select("doc_id", "lang", "source", "text"), production_tokenizer()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Sampling and models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
