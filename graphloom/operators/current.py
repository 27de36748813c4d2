"""Current rows of the stored tables: repeated rows fall together, the latest load of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import evidence_text
from graphloom.runtime import table

REVIEWED = ("approved", "uncertain", "skipped")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order``; nulls come first. Rows without a key are dropped."""
    at = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.where(F.col(key).isNotNull()).withColumn("_at", at).where("_at = 1").drop("_at")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "papers"), "id", "loaded_at", "status")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sentences").distinct()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "entity_mentions"), "id", "loaded_at", "canonical_entity_id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "relation_mentions").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entities and the shared vocabulary they stand beside."""
    return table(spark, sf_dir, "canonical_entities").unionByName(table(spark, sf_dir, "seed_entities"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "merge_candidates"), "id", "loaded_at", "status")


def mention_evidence(mentioned: DataFrame, read: DataFrame) -> DataFrame:
    """Mentions of the given sentences with the text each was found in."""
    s = read.select(F.col("id").alias("sentence_id"), "document_id", "ordinal", "page_number", "text", "context_before", "context_after")
    m = mentioned.withColumnRenamed("text", "mention_text")
    return m.join(s, "sentence_id").withColumn(
        "evidence", evidence_text(F.col("context_role"), F.col("context_before"), F.col("text"), F.col("context_after"))
    )


#: The same rows in SQL, for the queries' checks.
SQL = {
    "p": "p as (select * exclude (n) from (select *, row_number() over (partition by id order by loaded_at desc nulls last, status desc nulls last) as n from papers) where n = 1)",
    "s": "s as (select distinct * from sentences)",
    "m": "m as (select * exclude (n) from (select *, row_number() over (partition by id order by loaded_at desc nulls last, canonical_entity_id desc nulls last) as n from entity_mentions) where n = 1)",
    "r": "r as (select distinct * from relation_mentions)",
    "e": "e as (select * from canonical_entities union all select * from seed_entities)",
    "c": "c as (select * exclude (n) from (select *, row_number() over (partition by id order by loaded_at desc nulls last, status desc nulls last) as n from merge_candidates) where n = 1)",
}


def with_sql(names: str, rest: str) -> str:
    """A WITH clause of the named current tables before ``rest``."""
    return "with " + ", ".join(SQL[n] for n in names.split()) + ("" if rest.lstrip().startswith("select") else ",") + "\n" + rest
