"""Raw documents to training tokens: quality rules, line deduplication, near duplicates, decontamination, tokens.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the last one the
token ids. Documents leave in four ways: a quality rule rejects them; all their lines stand in earlier
documents; a near duplicate with a smaller id exists; a benchmark window occurs in them. Lines leave
where an earlier line is equal or within two edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, near_dup, quality_rules
from tessera.llm.catalog import VOCABULARY
from tessera.llm.tables import table
from tessera.llm.workspace import Workspace, scratch


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Statistics are written beside the documents, so both the cutoffs and the verdicts come from one measurement."""
    measured = Workspace(spark, "rules").save(quality_rules.statistics(docs), "measured")
    cutoffs = quality_rules.fit_cutoffs(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).where("q_kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; n_chars follows the text."""
    out = line_dedup.drop_lines(docs, line_dedup.line_classes(spark, docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dup.drop_duplicates(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return bpe.encode_texts(docs, VOCABULARY).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", keep_by_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: SQL can express neither the encoding nor the choice among near duplicates of edited texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():  # what a stage wrote on its way goes when its result stands
            docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
