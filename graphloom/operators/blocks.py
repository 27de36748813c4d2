"""Cleaning of parsed blocks: gates, paragraph merge, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as X


def _seen(flag: Column, by: str, order: tuple[str, ...], strictly: bool = False) -> Column:
    """Whether the flag held at any row so far, or at any row before."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strictly else 0)
    return F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(w), F.lit(False))


def gated(blocks: DataFrame, by: str = "document_id", order: tuple[str, ...] = ("block_no",)) -> DataFrame:
    """Blocks of (by, order, block_type, text) that belong to a paper's content, with their category.

    Page furniture, figures and metadata lines go; before the title also addresses, journal lines and
    short scraps; between title and body unpunctuated scraps; from the references on everything. Each
    gate is one running maximum over the survivors of the gates before.
    """
    text, kind = F.col("text"), F.col("block_type")
    rows = blocks.withColumn("text", X.clean_markdown(text)).where(~F.coalesce(kind, F.lit("")).isin(*X.SKIPPED_BLOCK_TYPES))
    rows = rows.where((text != "") & ~text.rlike(X.METADATA_LINE))
    title = F.coalesce(kind == "title", F.lit(False))
    plain = ~F.coalesce(kind, F.lit("")).isin(*X.EQUATION_TYPES)
    no_stop = ~text.rlike("[.!?。！？]")
    early = (
        F.lower(text).contains("doi.org")
        | text.rlike(r"(?iU)\bjournal\b|(?:https?://|www\.|\b\w+\.\w+\.\w+/)")
        | (plain & (F.length(text) < 30) & no_stop)
    )
    rows = rows.withColumn("_title", _seen(title, by, order)).where(F.col("_title") | ~early)
    rows = rows.where(~text.rlike(X.FRONT_MATTER))
    rows = rows.withColumn("_refs", _seen(X.is_references(text), by, order)).where(~F.col("_refs"))
    rows = rows.withColumn("category", X.block_category(kind, text))
    weak = ~title & F.col("_title") & (F.length(text) < 200) & no_stop
    body = F.col("category").isin("abstract", "main_text") & (F.length(text) >= 100) & ~weak
    rows = rows.withColumn("_weak", weak).withColumn("_body", _seen(body, by, order, strictly=True))
    return rows.where(~F.col("_weak") | F.col("_body")).drop("_title", "_refs", "_weak", "_body")


def flat_gated(blocks: DataFrame, by: str = "document_id", order: tuple[str, ...] = ("block_no",)) -> DataFrame:
    """The older flat form: furniture, metadata and references go, nothing else."""
    text, kind = F.col("text"), F.col("block_type")
    rows = blocks.withColumn("text", X.clean_markdown(text)).where(~F.coalesce(kind, F.lit("")).isin(*X.SKIPPED_BLOCK_TYPES))
    rows = rows.where((text != "") & ~text.rlike(X.METADATA_LINE))
    rows = rows.withColumn("_refs", _seen(X.is_references(text), by, order)).where(~F.col("_refs")).drop("_refs")
    return rows.withColumn("category", X.block_category(kind, text))


def before_references(files: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, block_no, text): the paragraphs of a text up to its list of references."""
    rows = files.where(F.col(text).isNotNull()).select(by, F.posexplode(X.chunks_by_blank_line(F.col(text))).alias("block_no", "text"))
    return rows.withColumn("_refs", _seen(X.is_references(F.col("text")), by, ("block_no",))).where(~F.col("_refs")).drop("_refs")


def markdown_blocks(files: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, block_no, page_number, block_type, text, category) of a whole Markdown text, cut at blank lines."""
    parts = files.select(by, F.posexplode(X.chunks_by_blank_line(X.clean_markdown(F.col(text)))).alias("block_no", "text"))
    t = F.col("text")
    kept = parts.where(~t.rlike(X.METADATA_LINE) & ~t.rlike(X.FRONT_MATTER))
    kept = kept.withColumn("_refs", _seen(X.is_references(t), by, ("block_no",))).where(~F.col("_refs")).drop("_refs")
    kept = kept.where(~t.rlike(r"(?i)!\[[^\]]*\]\([^)]+\)|<table\b") & ~t.rlike(r"(?iU)^\s*(?:fig(?:ure)?\.?|table)\s*\d+\b"))
    kept = kept.withColumn("block_type", F.when(t.startswith("#"), "title").otherwise("paragraph"))
    return kept.select(by, "block_no", F.lit(1).alias("page_number"), "block_type", "text", X.block_category(F.col("block_type"), t).alias("category"))


def merged(blocks: DataFrame, by: str = "document_id", order: str = "block_no") -> DataFrame:
    """Paragraph fragments joined until a sentence ends; the first fragment's place and category stay.

    Headings and equations stand alone and end what is open. An island begins at the first block, at and
    after a heading or equation, and after a block that ends a sentence; its texts are folded in order,
    a hyphen behind a letter falling away at a join.
    """
    w = W.partitionBy(by).orderBy(order)
    alone = F.col("category").isin("heading", "equation")
    closes = X.ends_sentence(F.col("text"))
    start = F.coalesce(F.lag(alone | closes).over(w), F.lit(True)) | alone
    rows = blocks.withColumn("_start", start).withColumn("_island", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "text")))
    rest = [c for c in blocks.columns if c not in (by, order, "text")]
    out = rows.groupBy(by, "_island").agg(
        F.min(order).alias(order), parts.alias("_parts"), *[F.min_by(c, order).alias(c) for c in rest], F.count("*").cast("int").alias("fragments")
    )

    def join(left: Column, part: Column) -> Column:
        cut = left.rlike(r"(?U)[A-Za-z]-\s*$")
        trimmed = F.when(cut, F.regexp_replace(left, r"(?U)-\s*$", "")).otherwise(F.concat(left, F.lit(" ")))
        return X.ustrip(F.concat(trimmed, part["text"]))

    texts = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get(F.col("_parts"), 0)["text"], join)
    return out.select(by, order, *rest, texts.alias("text"), "fragments")


def clean_document(blocks: DataFrame, by: str = "document_id", order: str = "block_no") -> DataFrame:
    """(by, markdown): the cleaned paper as Markdown, first heading as title, one Abstract heading."""
    text = X.clean_markdown(F.col("text"))
    rows = blocks.withColumn("text", text).where(F.col("text") != "")
    head = X.ustrip(F.regexp_replace("text", r"(?U)^#+\s*", ""))
    rows = rows.withColumn("_head", F.when(F.col("category") == "heading", head)).where(F.col("_head").isNull() | (F.col("_head") != ""))
    nth = F.row_number().over(W.partitionBy(by, "category").orderBy(order))
    bare = F.regexp_replace("text", r"(?iU)^\s*abstract\s*:?\s*", "")
    line = (
        F.when(F.col("category") == "heading", F.concat(F.when(F.col("_nth") == 1, "# ").otherwise("## "), "_head"))
        .when((F.col("category") == "abstract") & (F.col("_nth") == 1), F.concat(F.lit("## Abstract\n\n"), bare))
        .when(F.col("category") == "abstract", bare)
        .otherwise(F.col("text"))
    )
    lines = rows.withColumn("_nth", nth).select(by, F.struct(F.col(order).alias("at"), line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n\n")
    return lines.groupBy(by).agg(F.concat(X.ustrip(joined), F.lit("\n")).alias("markdown"))
