"""Deletion and replacement as rewrites of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unreferenced(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities no mention points to."""
    used = mentions.where("canonical_entity_id is not null").select(F.col("canonical_entity_id").alias("id")).distinct()
    return entities.join(used, "id", "left_anti")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the papers of ``gone`` (document_id), and the counts of what was removed.

    Sentences, formula assets, revisions, mentions and relations go with their paper, and relations that
    lose an end. Entities only the removed mentions pointed to go too, with their merge candidates;
    entities that other papers mention stay.
    """
    gone = gone.select("document_id").distinct()
    s, m, r = tables["sentences"], tables["mentions"], tables["relations"]
    dead = s.join(gone, "document_id", "left_semi").select(F.col("id").alias("sentence_id")).distinct()
    dead_m = m.join(dead, "sentence_id", "left_semi")
    left_m = m.join(dead, "sentence_id", "left_anti")
    touched = dead_m.where("canonical_entity_id is not null").select(F.col("canonical_entity_id").alias("id")).distinct()
    orphans = touched.join(left_m.select(F.col("canonical_entity_id").alias("id")), "id", "left_anti")
    left_r = r.join(dead, "sentence_id", "left_anti")
    for side in ("source_mention_id", "target_mention_id"):
        left_r = left_r.join(dead_m.select(F.col("id").alias(side)), side, "left_anti")
    out = dict(tables)
    out["papers"] = tables["papers"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")
    out["sentences"] = s.join(gone, "document_id", "left_anti")
    out["mentions"], out["relations"] = left_m, left_r.select(*r.columns)
    for name in ("revisions", "formula_assets"):
        if name in tables:
            out[name] = tables[name].join(dead, "sentence_id", "left_anti")
    out["entities"] = tables["entities"].join(orphans, "id", "left_anti")
    c = tables["candidates"]
    for side in ("left_entity_id", "right_entity_id"):
        c = c.join(orphans.select(F.col("id").alias(side)), side, "left_anti")
    out["candidates"] = c.select(*tables["candidates"].columns)
    counts = None
    for name, df in (("sentences", dead), ("mentions", dead_m), ("entities", orphans.join(tables["entities"].select("id"), "id", "left_semi"))):
        n = df.agg(F.count("*").alias("removed")).select(F.lit(name).alias("kind"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return out, counts


def files_of(papers: DataFrame, gone: DataFrame, formula_assets: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """(document_id, path): the files that go with the papers of ``gone`` (document_id), each once.

    These are the stored papers and the images of their formulas (sentence_id, image_path); whoever
    deletes removes them after the tables, which decide.
    """
    gone = gone.select("document_id").distinct()
    paths = papers.select(F.col("id").alias("document_id"), F.col("storage_path").alias("path"))
    if formula_assets is not None and sentences is not None:
        of = sentences.select(F.col("id").alias("sentence_id"), "document_id").distinct()
        paths = paths.unionByName(formula_assets.join(of, "sentence_id").select("document_id", F.col("image_path").alias("path")))
    return paths.where("path is not null and path <> ''").join(gone, "document_id", "left_semi").distinct()


def replace_document(sentences: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sentences with those of re-read papers replaced."""
    kept = sentences.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def with_context_role(mentions: DataFrame) -> DataFrame:
    """Old mention tables gain context_role 'current'."""
    return mentions if "context_role" in mentions.columns else mentions.withColumn("context_role", F.lit("current"))
