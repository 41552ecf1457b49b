"""A training-data pipeline over documents: each stage works on all that the one before it kept.

    language    drops documents without a letter and those of whose words less than MIN_KNOWN are in a script that a learned
                language uses, and fills a null lang with the prediction
    simhash     keeps one document, the one of the least doc_id, of each group of similar ones (five-word shingles, 0.8)
    benchmark   drops rows whose text leaks a benchmark item
    personal    replaces personal data in texts by its kind
    bpe         encodes the texts, decodes the ids and gives both digests

Rows with null or empty text, or text without a letter, end at the first stage; no stage reads other columns than doc_id, text, lang and
n_chars, and others pass through the first four, whatever their names. Rows of one doc_id but different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontaminate, lang_id, pii, similar
from tesserae.llm.common import table, unused, written

#: A document most of whose words no learned language could have is in none of them; one that mixes several of them is kept.
MIN_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score, known = unused(docs, "_lang", "_score", "_known")
    found = lang_id.identify(docs, lang_id.learn(docs), (lang, score, known)).where((F.col(lang) != "und") & (F.col(known) >= MIN_KNOWN))
    return found.withColumn("lang", F.coalesce("lang", lang)).drop(lang, score, known)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("simhash", near_duplicates),
    ("benchmark", benchmark),
    ("personal", personal),
    ("bpe", tokens),
]
#: SQL expresses neither the language model nor the groups; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
