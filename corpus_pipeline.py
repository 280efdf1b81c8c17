"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last returns the columns of ``documents``, and each judges a
row by its text: rows with null ids, or ids that several texts share, are
treated as any others. Only alike texts make rows go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm import bpe, decontam, langid, ngram_join, secrets
from semaspark.llm.common import discard, materialise, read_table, tidy
from semaspark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; those go that have no letter or whose
    phrases cost more than their letters one by one in every language."""
    model = langid.learn(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    own = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("own"), "text")
    return langid.identify(own, model).where("known").select(*[F.col("own")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    return ngram_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and lengths set anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with their token ids and whether the text decoded
    from these is the text."""
    own = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("own"), "text")
    out = bpe.round_trip(own, tokenizer_path())
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    kept = [F.col("own")[c].alias(c) for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return out.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express language ID nor the tests of randomness.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over ``documents``. Each stage's table is deleted
    once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, tidy(lambda f=stage, d=docs: materialise(f(spark, d, sf_dir)))()
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
