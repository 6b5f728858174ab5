"""A training corpus from raw documents: rules, near-dedup, decontamination, secret scan, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but the last return
the columns of ``documents``, and any further ones of their input, whatever their names. All of them work on an empty table, on texts of any length,
and on rows whose id, or any other column, is null or repeated; what each does with them stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactdq.llm import decontamination, near_dedup, packing, quality_rules, secrets
from contactdq.llm.common import written
from contactdq.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go. A null, empty or blank text is rejected for its few words; each of repeated rows is judged alike."""
    return quality_rules.filter_documents(docs, quality_rules.POLICIES["strict-1"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id; one without an id only where the whole class has none.

    Texts without words are in no class and all stay. Of rows that repeat id and text one stays, that with the least hash of all its columns.
    """
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, all of them where a text repeats. Null and empty texts, and all with an empty benchmark, stay."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), 10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, a null text as null. ``n_chars``, where there is one, follows a changed text."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; one row for each piece. A null or empty text is its end id alone, and repeated rows are packed each by itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("secret_scans", without_secrets), ("packing", packed)]

#: Best-fit packing has no SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
