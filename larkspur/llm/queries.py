"""The queries of this subpackage, as the driver registers them: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import special_tokens
from .bpetree import decode_ids, encode_texts
from .chat import FORMAT_CHATS_SQL, format_chats
from .common import crc32_mod, table
from .hmm import hmm_scores
from .langid import identify, train_dictionaries
from .minhash import MINHASH_SQL, minhash_near_duplicates
from .packing import pack_documents
from .quality import QUALITY_RULES_SQL, quality_rules
from .tokencount import token_counts
from .vectors import VECTORS_SQL, vector_near_duplicates
from .warc import ROUND_TRIP_SQL, round_trip

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SPECIAL = special_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN, capacity=2048, end_id=0, special=SPECIAL)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95).rows


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("policy", F.lit(0)).alias("policy"), "kept")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode_ids(encode_texts(table(spark, sf_dir, "documents"), RANKS, PATTERN), RANKS, PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), RANKS, PATTERN, fields=("text",), lines=True, rule="start")


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"), min_revisit=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod("doc_id", 4) == 2
    model = train_dictionaries(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "language.*").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod("doc_id", 10) == 0
    found = hmm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_embedding_near_dedup": op3_embedding_near_dedup, "op4_quality_rules": op4_quality_rules, "op5_bpe_codec": op5_bpe_codec, "op6_token_counts": op6_token_counts,
    "op7_warc_bundles": op7_warc_bundles, "op8_language_id": op8_language_id, "op9_hmm_scoring": op9_hmm_scoring, "op10_chat_format": op10_chat_format,
}
ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dedup": MINHASH_SQL, "op3_embedding_near_dedup": VECTORS_SQL, "op4_quality_rules": QUALITY_RULES_SQL, "op7_warc_bundles": ROUND_TRIP_SQL, "op10_chat_format": FORMAT_CHATS_SQL}
