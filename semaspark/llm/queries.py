"""Registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm import bpe, chat, decontam, embed_dedup, langid, licenses, ngram_join, pii, secrets, toxicity
from semaspark.llm.common import read_table
from semaspark.llm.oracles import ORACLES, licences


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, tokenizer_path(), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _joined(spans: str, base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    found = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counts(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *_counts("pii", pii.KINDS), F.sha2(_joined("pii", True), 256).alias("base_sha256"), _joined("pii").alias("spans"), (F.size("pii") > 0).alias("has_pii"))


def _crc_mod(key: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def op3_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op4_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _crc_mod("doc_id", 4) == 2
    model = langid.learn(docs, ~held_out)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_decontamination_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.screen(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.sort_array(F.col("item_ids").cast("array<string>")), ",").alias("item_ids"), F.round("similarity", 6).alias("similarity"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, thousand and two hundred
    ids, in which every tenth document stands as a LICENSE file."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 200).cast("string"))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", "text", F.concat_ws("/", folder, name).alias("path"))
    found = licenses.scan(files)
    return found.select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin")


def op7_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = _crc_mod("doc_id", 5) == 0
    model = toxicity.learn_characters(docs)
    scorer = toxicity.learn(docs, labels, ~held_out, model)
    found = toxicity.score(docs, model, scorer, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "marked")


def op8_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *_counts("secrets", secrets.KINDS[:3]), F.sha2(_joined("secrets", True), 256).alias("base_sha256"), _joined("secrets").alias("spans"), (F.size("secrets") > 0).alias("has_secret"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_weak_supervision": op1_pii_weak_supervision,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_chat_snapshot_collapse": op3_chat_snapshot_collapse,
        "op4_language_cross_parsing": op4_language_cross_parsing,
        "op5_decontamination_simhash": op5_decontamination_simhash,
        "op6_license_scan": op6_license_scan,
        "op7_toxicity_noisy_channel": op7_toxicity_noisy_channel,
        "op8_secret_randomness": op8_secret_randomness,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op6_license_scan": licences(licenses.TEMPLATES, licenses.HEADER)}
