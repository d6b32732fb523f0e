"""Corpus pipeline: language, near copies, personal data, mixture, tokens; each stage works on all that the one before kept."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.llm import bpe, hyperlang, mixing, personal, simhash
from reposift.llm.common import ROW_KEY, one_per_key, row_key, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose letters point to no learned language at all is rejected.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language their text shows; those without a letter or close to no learned language go.

    A null or empty text has no letter.  Each row is judged alone: repeated
    rows, null and repeated ids stay as they are.  An empty table gives no row;
    columns other than COLUMNS are dropped, here and in the next stages.
    """
    found = hyperlang.identify_languages(docs.select(*COLUMNS), n=3, dim=1024)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of three-word shingles within 2 bits, directly or through others.

    The row with the smallest doc_id stays, null last; of rows equal in doc_id
    and text one.  Different texts under one id, or without id, are different
    documents.  Null and empty texts are copies of each other.
    """
    return simhash.drop_copies(docs.select(*COLUMNS), threshold=2, shingle=3).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; n_chars follows the text.

    Null and empty texts, and rows without a span, stay as they are; each row is
    judged alone.
    """
    found = personal.find_personal_data(docs, keep=COLUMNS)
    text = personal.redact(F.col("text"), F.col("spans"))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none, once or twice.

    Null and empty texts are never taken.  Rows are told apart by id, source
    and text; of rows equal in all three one comes as often as the mix takes
    them together.
    """
    keyed = docs.select(*COLUMNS).withColumns(row_key("doc_id", "source", "text"))
    mixed = mixing.mix_sources(keyed, weights=(3, 1, 2), share=1.5, most=2, keep=ROW_KEY)
    times = mixed.groupBy(*ROW_KEY).agg(F.count("*").alias("_rows"), F.sum("times").alias("_times")).where("_times > 0")
    taken = one_per_key(keyed, staged(times, "times"))
    return taken.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again as a check: digests and counts, a row per row; a null text is empty."""
    return bpe.token_digests(bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens),
]
#: Language, near copies and byte-level merges can't be told in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
