"""Documents to token ids: language, near copies, benchmark passages, personal data, tokens.

``STAGES`` lists the stages; each takes all rows its predecessor kept and all
but the last return the columns of ``documents``.  ``run`` applies them in
order, each result being written to the shared folder and read again.

Defined for all stages: columns of any name pass unchanged; an empty table gives an empty one; texts of any
length are read whole; rows are independent of each other except among near copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzmill.llm import decontaminate, langid_bigru, near_copies, pii_pseudonyms, scratch, sentencepiece_codec

#: A text whose language is less certain is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.3


def _guarded(docs: DataFrame, use: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """``use`` under column names of its own, so that no column of ``docs`` can clash; gives back all columns."""
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    out = use(docs.toDF(*names.values()), names)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty ones too) or of no certain language.

    The model learns from rows with a language; repeated rows share their fate; of equal probabilities the first language in order counts.
    """
    scratch.ready(spark)
    model = langid_bigru.fit(docs)
    scratch.release()  # what the fit held on the driver

    def use(d: DataFrame, name: dict[str, str]) -> DataFrame:
        found = langid_bigru.predict(d, model, d.columns, name["text"])
        return found.where((F.col("lang_pred") != langid_bigru.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))

    return _guarded(docs, use)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: the least id, a null id only where there is no other.

    Five-word shingles and a similarity of 0.8. Operator 10's SimHash links come first; as its bits do not reach that similarity, its deletion
    variants over a shingle signature find the rest; exact sets decide on both. Null and blank texts are copies of each other; rows that repeat id and text give one.
    """
    return _guarded(docs, lambda d, name: near_copies.deduplicated(d, name["doc_id"], name["text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none and stay; repeated rows share their fate."""
    items = scratch.table(spark, sf_dir, "benchmark")
    return _guarded(docs, lambda d, name: decontaminate.contaminated(d, items, d.columns, name["text"]).where(F.size("matches") == 0))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format and length, equal values by equal ones. Null and empty texts and repeated rows stay as they are."""
    return _guarded(docs, lambda d, name: pii_pseudonyms.pseudonymise(d, pii_pseudonyms.secret_key(spark), name["text"]))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. Null and empty texts have none; each row keeps its own."""
    return sentencepiece_codec.encode(docs, [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = scratch.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch.new_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        if before:  # what the stage before wrote is read no more
            scratch.delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
