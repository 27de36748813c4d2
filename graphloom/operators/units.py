"""Sentence and formula units of blocks, their order and their context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import is_equation_number, is_formula, sentences_of, squeezed


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, unit): the sentences of every text, ordinals from 0; null and empty texts have none."""
    return documents.select(key, F.posexplode(sentences_of(F.col(text))).alias("ordinal", "unit"))


def line_runs(blocks: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """(key, run_no, is_formula, run_text): consecutive formula lines, and the prose lines between them.

    An equation number stays with a formula run it follows and is prose anywhere else. All is done inside
    a block's own row: an island starts where a line's class differs from the line's before.
    """
    kept = F.filter(F.transform(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n"), squeezed), lambda x: x != "")
    lines = blocks.select(key, F.posexplode(kept).alias("at", "line"))
    lines = lines.withColumn("kind", F.when(is_formula(F.col("line")), "formula").when(is_equation_number(F.col("line")), "number").otherwise("prose"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line", "kind")))
    # the class of a number is that of the line before; runs are folded in one pass over the block's array
    run = "struct<formula: boolean, lines: array<string>>"
    start = F.array().cast(f"array<{run}>")

    def step(runs, x):
        last = F.try_element_at(runs, F.lit(-1))
        formula = (x["kind"] == "formula") | ((x["kind"] == "number") & F.coalesce(last["formula"], F.lit(False)))
        same = F.coalesce(last["formula"] == formula, F.lit(False))
        grown = F.struct(formula.alias("formula"), F.when(same, F.concat(last["lines"], F.array(x["line"]))).otherwise(F.array(x["line"])).alias("lines"))
        return F.concat(F.when(same, F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(runs), F.array(grown.cast(run)))

    runs = lines.groupBy(key).agg(ordered.alias("l")).select(key, F.posexplode(F.aggregate("l", start, step)).alias("run_no", "r"))
    return runs.select(key, "run_no", F.col("r.formula").alias("is_formula"), F.array_join("r.lines", "\n").alias("run_text"))


def block_units(blocks: DataFrame, key: str = "block_id", text: str = "text") -> DataFrame:
    """(key, ordinal, unit, is_formula): formula runs whole, prose runs cut into sentences."""
    runs = line_runs(blocks, key, text)
    parts = F.when(F.col("is_formula"), F.array("run_text")).otherwise(sentences_of(F.col("run_text")))
    units = runs.select(key, "run_no", "is_formula", F.posexplode(parts).alias("at", "unit"))
    order = W.partitionBy(key).orderBy("run_no", "at")
    return units.select(key, (F.row_number().over(order) - 1).alias("ordinal"), "unit", "is_formula")


def with_context(units: DataFrame, by: str = "document_id", order: str = "ordinal", text: str = "text") -> DataFrame:
    """Adds is_formula, before and after.

    A prose unit sees the units next to it, a formula the nearest prose on each side. Documents are
    windows of their own; a unit at an end has no neighbour there.
    """
    w = W.partitionBy(by).orderBy(order, text)
    flagged = units.withColumn("is_formula", is_formula(F.col(text)))
    prose = F.when(~F.col("is_formula"), F.col(text))
    back = F.last(prose, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.first(prose, True).over(w.rowsBetween(1, W.unboundedFollowing))
    return flagged.select(
        "*",
        F.when(F.col("is_formula"), back).otherwise(F.lag(text).over(w)).alias("before"),
        F.when(F.col("is_formula"), ahead).otherwise(F.lead(text).over(w)).alias("after"),
    )
