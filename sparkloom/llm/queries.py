"""One query per operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import oracles
from sparkloom.llm.chat_format import ChatFormat
from sparkloom.llm.decontamination import Decontamination
from sparkloom.llm.embedding_dedup import EmbeddingDedup
from sparkloom.llm.hard_negatives import HardNegatives
from sparkloom.llm.labelled import fold
from sparkloom.llm.lexical_search import RankedSearch
from sparkloom.llm.licenses import LicenseScan
from sparkloom.llm.ngram_join import NgramJaccardJoin
from sparkloom.llm.packing import LengthBuckets
from sparkloom.llm.quality import QualityRanking
from sparkloom.llm.recompression import SubstringDedup
from sparkloom.llm.sharding import HilbertShards
from sparkloom.llm.toxicity import ToxicityGrammar
from sparkloom.llm.warc_zip import round_trip


def op1_subspace_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more."""
    return EmbeddingDedup(cosine=0.95).run(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_optimal_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 padding-minimal buckets, batches of 65536 padded words."""
    return LengthBuckets(buckets=16, max_tokens=4096, token_budget=65536).run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_warc_zip_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in ZIP packages, read back by range."""
    back = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier elsewhere, removed."""
    return SubstringDedup(window=20).run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 runs of equal count along the curve."""
    shards = HilbertShards(shards=40)
    return shards.run(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit(shards.law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside fold 0 of 5. Each row is scored by its own text; held_out is null for a null doc_id."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = ToxicityGrammar(folds=5, held_out=0)
    scored = grammar.score(docs, grammar.fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside 10-word windows of benchmark items."""
    found = Decontamination(window=10).run(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license signatures of every document."""
    found = LicenseScan().run(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op9_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside fold 2 of 4. Each row is scored by its own text; held_out is null for a null doc_id."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = QualityRanking(folds=4, held_out=2, at=0.7).run(docs, labels)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 4-word shingles at a Jaccard similarity of 0.85 or more."""
    return NgramJaccardJoin(n=4, percent=85).run(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    return RankedSearch(k=10).run(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are shifted first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return HardNegatives(positives=5, negatives=10, low=30, high=90, scale=256).run(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as formatted text, read back from it; conversation -1 says control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chat = ChatFormat()
    back = chat.read_back(chat.format(chat.from_rows(turns.unionByName(control))).select("conv_id", "formatted", "loss"))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("read_loss", "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), digest(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


QUERIES = {
    "op1_subspace_pigeonhole_join": op1_subspace_pigeonhole_join,
    "op2_optimal_length_buckets": op2_optimal_length_buckets,
    "op3_warc_zip_reader": op3_warc_zip_reader,
    "op4_recompression": op4_recompression,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_aho_corasick_decontamination": op7_aho_corasick_decontamination,
    "op8_license_signatures": op8_license_signatures,
    "op9_bradley_terry_quality": op9_bradley_terry_quality,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_norm_bucket_search": op11_norm_bucket_search,
    "op12_strassen_hard_negatives": op12_strassen_hard_negatives,
    "op13_schema_fingerprint_chat": op13_schema_fingerprint_chat,
}
ORACLES: dict[str, str] = {
    "op1_subspace_pigeonhole_join": oracles.EMBEDDINGS,
    "op4_recompression": oracles.REPEATS,
    "op7_aho_corasick_decontamination": oracles.LEAKS,
    "op10_ngram_jaccard_join": oracles.JACCARD,
    "op11_norm_bucket_search": oracles.RANKED,
    "op12_strassen_hard_negatives": oracles.NEGATIVES,
    "op13_schema_fingerprint_chat": oracles.CHAT,
    "op3_warc_zip_reader": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html""",
}
