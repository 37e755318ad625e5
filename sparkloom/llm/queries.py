"""The registered queries of this subpackage: thin uses of the operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..sources.tables import spread
from . import bpe, decontam, langid, ngram_join, paragraphs, shards, suffix, syncmers, token_counts, urls
from .oracles import ORACLE_SQL as ORACLE_SQL  # the others are tested against brute force

RANKS = "byte_bpe_multi_50k.tiktoken"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows dealt out to all cores where it comes as fewer pieces."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its repeated paragraphs: what was removed, and the text that stays."""
    out = paragraphs.substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_paragraphs").alias("n_paragraphs"), F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed"), "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every text. Null and empty texts have no tokens; each row gives a row, repeated ones and null ids too."""
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. Null texts count as empty; null ids come first, ties of an id by text; an empty table gives no rows."""
    return syncmers.edited(load(spark, sf_dir, "documents"))


def op3_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_syncmer_fingerprints that SQL can express: lengths and digests of the edited texts. Null texts count as empty; rows are as in it."""
    return op3_syncmer_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. Null and wordless texts are alone; repeated rows share a component."""
    return ngram_join.ngram_jaccard(load(spark, sf_dir, "documents"), width=4, percent=85)


def op4_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_ngram_jaccard_join with n_links: every link between different texts is compared and counted."""
    return ngram_join.ngram_jaccard(load(spark, sf_dir, "documents"), width=4, percent=85, count_links=True)


def op5_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a place in it for every document, by the law of near equal bytes. Null texts have size 1; null ids hash by their text; ties by size and checksum."""
    out = shards.shard(load(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows and the items they come from, a row for each document. Null texts have no words."""
    found = decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["last"] - s["first"] + 1))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of 200 bytes, removed from every text. Null texts count as empty; repeated rows repeat each other."""
    found = suffix.suffix_dedup(load(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from documents that aren't held out. Null texts and those without a letter are und; equal scores go to the first language."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    filters = langid.learn(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def held_out(doc_id: str):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every URL. Null URLs have empty host and path; repeated rows are judged alike."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(urls.labelled_by_rules(pages, urls.RULES))
    return urls.judge(pages, model, urls.RULES).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_score").alias("score"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_url_filter that SQL can express: host, path and rule of each URL, and the verdict where a rule speaks, else null."""
    out = op9_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every text; a token over a boundary counts to the line of its first byte. Null and empty texts have one empty line."""
    return token_counts.section_token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_syncmer_fingerprints, op3_edited_texts, op4_ngram_jaccard_join, op4_ngram_jaccard_links, op5_virtual_slot_shards, op6_fm_decontamination, op7_suffix_dedup, op8_language_id, op9_url_filter, op9_url_rules, op10_token_counts, pipeline)}
