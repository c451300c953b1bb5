"""A corpus pipeline: each stage gets what its predecessor kept, as a table of documents.

Cases, of every stage: rows count by doc_id and text, so null and shared ids keep their good rows and equal
rows share a verdict; null and empty texts fail the quality rules; very long texts are worked on whole; an empty
table passes through with its columns; further columns stay up to the last stage, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import bpe, common, decontaminate, jaccard_join, quality_rules, surrogates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = common.keyed(docs)
    return common.unkeyed(common.without(docs, quality_rules.apply_rules(docs).where("NOT kept").select("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    docs = common.keyed(docs)
    return common.unkeyed(common.without(docs, decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the text."""
    out = surrogates.pseudonymise(docs)
    return out.select(*(F.char_length("text").cast(t).alias(c) if c == "n_chars" else c for c, t in docs.dtypes))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the decoded text, and the ids themselves."""
    return bpe.encode_decode(docs, outputs=("ids_sha256", "decoded_sha256", "ids"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("encoding", encoding)]
#: The stages run numpy and tokenizers, which SQL can't express; they are tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each result is a table before the next one begins."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stage(docs)
    return docs
