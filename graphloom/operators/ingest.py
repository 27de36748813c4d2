"""From parsed blocks to the stored sentences of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import is_formula, sentences_of
from graphloom.operators import blocks as B
from graphloom.operators.units import with_context


def ingested(parsed: DataFrame, flat: bool = False) -> DataFrame:
    """Sentences (id, document_id, ordinal, page_number, text, context_before, context_after, status, is_formula).

    Blocks are gated and merged; headings fall away, equations stay whole, prose is cut into sentences.
    Ordinals run from 0 over pages, blocks and units; ids are made of paper and ordinal, so a second run
    gives the same rows.
    """
    kept = B.merged(B.flat_gated(parsed) if flat else B.gated(parsed)).where("category <> 'heading'")
    unit = F.when(F.col("category") == "equation", F.array("text")).otherwise(sentences_of(F.col("text")))
    rows = kept.select("document_id", "block_no", "page_number", F.posexplode(unit).alias("at", "text"))
    order = W.partitionBy("document_id").orderBy("page_number", "block_no", "at")
    rows = rows.withColumn("ordinal", F.row_number().over(order) - 1).drop("block_no", "at")
    told = with_context(rows)
    return told.select(
        F.concat_ws("-", "document_id", "ordinal").alias("id"), "document_id", "ordinal", "page_number", "text",
        F.col("before").alias("context_before"), F.col("after").alias("context_after"), F.lit("pending").alias("status"), "is_formula",
    )


def ingest_status(parsed: DataFrame, sentences: DataFrame) -> DataFrame:
    """(document_id, page_count, sentence_count, status) of parsed papers; one without any sentence has failed."""
    pages = parsed.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    counts = sentences.groupBy("document_id").agg(F.count("*").cast("int").alias("sentence_count"))
    status = F.when(F.coalesce("sentence_count", F.lit(0)) > 0, "reviewable").otherwise("parse_failed")
    return pages.join(counts, "document_id", "left").select("document_id", "page_count", F.coalesce("sentence_count", F.lit(0)).alias("sentence_count"), status.alias("status"))


def formula_assets(sentences: DataFrame, boxes: DataFrame) -> DataFrame:
    """(sentence_id, page_number, bbox) of formula sentences, with the box of the block they came from."""
    f = sentences.where(is_formula(F.col("text"))).select(F.col("id").alias("sentence_id"), "document_id", "page_number", "text")
    b = boxes.select("document_id", "page_number", "text", "bbox").where("bbox is not null and size(bbox) = 4")
    first = b.groupBy("document_id", "page_number", "text").agg(F.min("bbox").alias("bbox"))
    return f.join(first, ["document_id", "page_number", "text"], "left").select("sentence_id", "page_number", "bbox")


def sentence_listing(sentences: DataFrame, document_id: str) -> DataFrame:
    """A paper's sentences by ordinal with their kind."""
    rows = sentences.where(F.col("document_id") == document_id)
    kind = F.when(is_formula(F.col("text")), "formula").otherwise("sentence")
    return rows.withColumn("content_type", kind).orderBy("ordinal")
