"""The corpus pipeline: five operators in a row over ``documents``.

Every stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns
of ``documents``.

1. quality: documents that fail the rules, or whose host is rejected, go.
2. near_dedup: of each group of near copies the document with the smallest id stays.
3. decontaminate: documents with at least one word in twenty inside benchmark windows go.
4. secrets: secrets are replaced in the texts; every document stays.
5. mix: what the mix takes of each remaining document.

Every stage takes texts of any length whole; columns that a stage has no use for stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import read_table
from cellweave.llm.decontaminate import drop_contaminated
from cellweave.llm.mixing import mix_sources
from cellweave.llm.quality import keep_quality
from cellweave.llm.secrets import redact
from cellweave.llm.simhash import keep_one_of_each
from cellweave.sources.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; rejected documents go, null and empty texts among them.  Repeated rows and rows with null ids or hosts are
    judged each; an empty table stays empty."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, as its contract says: 3-word shingles, at most 3 differing bits; one document a group stays.

    Of repeated rows one stays, texts without words are one group, ties go to the smallest id (null last); an empty table stays
    empty."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; contaminated documents go, the others stay as they are.

    Texts without words are not contaminated; repeated rows are judged each; an empty table, or benchmark, changes nothing."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; secrets are cut out of the texts.  All rows stay, null texts and repeated rows as they are."""
    return redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; a row for each document with what is taken of it.

    Null and empty texts have size 0, null sources are a source, repeated rows are rounded each; an empty table gives none."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: Near-duplicate groups and the dependent rounding are beyond SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
