"""The corpus operators as registered queries: thin selections over each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, dedup, language, licenses, oracles, pieces, secrets, tokens, topk, toxicity, urls
from tessera.llm.common import read

TOKENIZER = "piece_bpe_32k.model"
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def model_bytes(name: str = TOKENIZER) -> bytes:
    """A public tokenizer's file; it is read where it lies."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that language models must not learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machines = language.fit(docs, F.col("text"), F.col("lang"), ~held_out(), F.col("doc_id"))
    found = language.identify(docs, F.col("doc_id"), F.col("text"), machines)
    return found.select(F.col("row_id").alias("doc_id"), F.coalesce(F.crc32(F.col("row_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), F.col("language").alias("lang_pred"), "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, read(spark, sf_dir, "labels"), "doc_id", "text", {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    found = toxicity.score(docs, F.col("doc_id"), F.col("text"), chain)
    return found.select(F.col("row_id").alias("doc_id"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.least[-1]).alias("toxic"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    edges = urls.page_edges(pages, F.col("url"), F.col("html"))
    out = urls.filter_urls(pages, F.col("page_id"), F.col("url"), urls.rules_of(*URL_RULES), edges)
    return out.select(F.col("row_id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), F.col("doc_id"), F.col("text"))
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.sample_pieces(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), model_bytes())
    return found.select(F.col("row_id").alias("doc_id"), "sample", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0, 10)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), F.col("source"), F.col("source"), kinds=secrets.KINDS)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    class_of = lambda c: F.size(F.filter("spans", lambda s: s["class"] == c)).cast("bigint")
    return found.select(
        F.col("row_id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), class_of("live").alias("n_live"), class_of("example").alias("n_example"),
    )


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_limits(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), model_bytes())
    return found.withColumnRenamed("row_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_url_filter": op3_url_filter,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_top_k": op6_top_k,
        "op7_near_dedup": op7_near_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_count": op10_token_count,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express; the others are tested against brute force, round trips or held-out rows."""
    return {"op3_url_filter": oracles.OP3, "op4_benchmark_decontamination": oracles.OP4, "op6_top_k": oracles.OP6, "op8_license_scan": oracles.OP8, "op9_secret_scan": oracles.OP9}
