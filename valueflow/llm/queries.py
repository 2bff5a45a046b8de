"""Registered queries of the training-data operators.

Each entry reads its whole table, runs the operator with production
parameters and derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chat, decontaminate, jaccard_join, mixing, quality, secrets, sharding, topk, toxicity, url_filter, warc,
               whitening)
from .common import holdout, table, written

#: Fixed values: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pattern rules for urls that no host rule fits.
URL_PATTERNS = ["||ads-track.*^", "-bets.", "||casino-win.", "||cheap-pills.", "||spam-farm.", "||adult-x.", "@@||example.net^en^1*^", "utm_source=feed|", "^index.php^"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.make_rules(URL_RULES, URL_PATTERNS)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.pattern")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", sharding.record_bytes(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                         F.lit("rows").alias("law"), "_shard.shard", "_shard.slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", holdout(F.col("doc_id")).alias("held_out"), "_toxic.score", "_toxic.predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("_bench.items")
    return found.select("doc_id", "_bench.n_words", "_bench.n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
                        decontaminate.is_contaminated(F.col("_bench")).alias("contaminated"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.col("_secrets")[kind]).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.col("_secrets.base").cast("binary"), 256).alias("base_sha256"), "_secrets.spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", holdout(F.col("doc_id")).alias("held_out"), "_quality.score", "_quality.predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "_near.class_id", "_near.n_links")


#: A conversation that holds the template's own control strings.
CONTROL_STRINGS = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_STRINGS), (-7, 1, "assistant", CONTROL_STRINGS)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    packs, membership = chat.format_conversations(rows)
    return membership.join(chat.read_back(packs), "path_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: Where the vocabularies of public tokenizers lie.
TOKENIZERS = os.environ.get("VALUEFLOW_TOKENIZERS", "/opt/tokenizers")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("_align.n_groups") == 0, "").otherwise(F.sha2(F.col("_align.groups").cast("binary"), 256))
    stored = written(aligned.select("doc_id", F.col("_align").dropFields("groups").alias("_align"), digest.alias("groups_sha256")), "aligned")
    found = alignment.weighed(stored, alignment.pair_counts(stored), alignment.max_pairs(a, b))
    return found.select("doc_id", "_align.n_a", "_align.n_b", "_align.n_groups", "_align.n_links", "_align.n_best", "_align.count_sum", "groups_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 4)
    found = rows.select("vec_id", F.col("_white.deviation").try_cast("long").alias("deviation"), F.posexplode("_white.whitened").alias("place", "whitened"))
    share = F.array(*(F.lit(e).cast("double") for e in model.explained)) if model.explained else F.array().cast("array<double>")
    return found.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                        F.get(share, "place").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.read_archives(spark, folder)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"), "url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_topk, op3_sharding, op4_mixing, op5_toxicity, op6_decontamination, op7_secrets,
        op8_quality, op9_jaccard_join, op10_chat, op11_alignment, op12_whitening, op13_warc)
}
