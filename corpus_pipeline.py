"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import decontaminate, jaccard_join, pii, quality, transducer
from wirelens.llm.common import table
from wirelens.llm.queries import tokenizer_path
from wirelens.workspace import materialize

#: Near duplicates: five words and a similarity of 0.8 or more.
NEAR = jaccard_join.Settings(width=5, num=80, den=100)


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rows, the column that tells them apart): the id where it does, else a row number, written with the rows."""
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if not odd.head(1):
        return docs, "doc_id"
    return materialize(docs.withColumn("row_of_stage", F.monotonically_increasing_id()), "numbered"), "row_of_stage"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go; rows and columns stay as they are. Null and empty texts break the least
    length; repeated rows are judged alike; ids are not looked at; texts are read whole; an empty table stays empty."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one document stays: that with the least id, a null id last, and of rows that
    repeat the id one. Every row is a document of its own, so rows that share an id, or have none, stay where their
    texts differ. Texts without words are no duplicates; an empty table stays empty."""
    rows, key = told_apart(docs)
    joined = jaccard_join.jaccard_join(rows, NEAR, key)
    if key == "doc_id":
        gone = joined.where("doc_id <> component_id").select("doc_id")
    else:
        groups = materialize(joined.select(key, "component_id"), "groups")
        ranked = groups.join(rows.select(key, "doc_id"), key)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key))
        kept = ranked.groupBy("component_id").agg(least.alias("least")).select(F.col(f"least.{key}").alias(key))
        gone = groups.join(kept, key, "left_anti").select(key)
    return decontaminate.without(rows, gone, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, with other values or in other case too. Rows are judged one
    by one, also those that share an id or have none; null and empty texts stay; empty tables change nothing."""
    rows, key = told_apart(docs)
    found = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(key)
    return decontaminate.without(rows, found, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows the masked text. Rows, ids and other columns stay; null texts
    stay null with their n_chars; an empty table stays empty."""
    masked = pii.redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as piece numbers, with the check that they decode to it again: one row per input row, whatever its id;
    null texts are empty; an empty table gives no rows."""
    return transducer.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: masking and shortest paths are not expressible. The tests compare with brute force.
ORACLE_SQL = None
