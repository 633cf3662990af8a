"""A corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, leaked benchmark documents go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. A
doc_id names a document: rows that share one are versions of it, and a decision that
rests on doc_id takes or leaves them together. Rows with a null doc_id are judged by
their own text and are never copies or leaks of others; null and empty texts have no
words, pass every filter but count for nothing, and end as a row without a batch. Empty
tables give empty tables, and ties go to the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.decontamination import Decontamination
from sparkloom.llm.ngram_join import NgramJaccardJoin
from sparkloom.llm.packing import LengthBuckets
from sparkloom.llm.recompression import SubstringDedup
from sparkloom.llm.session import new_folder
from sparkloom.llm.toxicity import ToxicityGrammar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5; what it learns comes from labelled rows outside the held-out fold. Each row is scored on its own, without a doc_id too; a text without words scores low and stays."""
    grammar = ToxicityGrammar()
    model = grammar.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grammar.score(docs, model, carry=COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at 0.8 or more; documents without words are no copies of each other, and rows without a doc_id stay. Versions of one document stay or go together."""
    groups = NgramJaccardJoin(n=5, percent=80).run(docs)
    copies = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that 20-word windows starting earlier elsewhere cover; a row of which nothing is left goes, one that had no words stays as it is. Equal windows at the same place of rows that share a doc_id are not earlier than each other; a null doc_id comes last."""
    kept = SubstringDedup(window=20).run(docs, with_text=True, carry=COLUMNS[1:])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~changed | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item stands. If a version of a document has one, its other versions go too; rows without a doc_id stay, and so do texts without words."""
    found = Decontamination(window=10).run(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where(F.size("spans") > 0).select("doc_id")
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of 65536 padded words in 16 length buckets; texts without words are rows without a bucket. Repeated rows are sequences of their own."""
    return LengthBuckets(buckets=16, max_tokens=4096, token_budget=65536).run(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Stages that learn or search by dynamic programming have no SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
