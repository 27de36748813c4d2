"""Fleiss' kappa over category counts and over annotation revisions."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.numbers import kappa_label
from graphloom.runtime import materialise


def fleiss(votes: DataFrame, by: list[str], raters: int) -> DataFrame:
    """(by, items, observed, expected, kappa) from rows (by, item, category, votes).

    Two aggregations: squared counts per item, rates per category. Rounded to 6 places; no item gives
    nulls, and where chance alone explains everything kappa is null. Raises when an item's votes aren't
    ``raters``.
    """
    if raters < 2:
        raise ValueError("at least two raters")
    if not by:
        return fleiss(votes.withColumn("_all", F.lit(0)), ["_all"], raters).drop("_all")
    per_item = votes.groupBy(*by, "item").agg(
        F.sum("votes").alias("n"), F.sum(F.col("votes") * F.col("votes")).alias("squares")
    )
    checked = F.when(F.col("n") == raters, (F.col("squares") - raters) / F.lit(float(raters * (raters - 1)))).otherwise(
        F.raise_error(F.lit("an item's votes differ from the number of raters"))
    )
    items = per_item.groupBy(*by).agg(F.count("*").alias("items"), F.avg(checked).alias("po"))
    per_category = votes.groupBy(*by, "category").agg(F.sum("votes").alias("c"))
    total = per_category.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).cast("double").alias("cc"), F.sum("c").alias("all"))
    both = items.join(total, by)
    pe = F.col("cc") / (F.col("all") * F.col("all"))
    kappa = F.when(F.abs(1 - pe) >= 1e-12, (F.col("po") - pe) / (1 - pe))
    return both.select(
        *by, "items", F.round("po", 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(kappa, 6).alias("kappa")
    )


def binary_votes(votes: DataFrame, raters: int) -> DataFrame:
    """Present/absent votes of (item, present) as category rows."""
    pair = F.explode(F.array(F.struct(F.lit("PRESENT").alias("category"), F.col("present").alias("votes")), F.struct(F.lit("NONE").alias("category"), (raters - F.col("present")).alias("votes"))))
    return votes.select("item", pair.alias("v")).select("item", "v.category", "v.votes")


def latest_revisions(revisions: DataFrame, raters: int) -> DataFrame:
    """The last ``raters`` revisions of sentences that have so many."""
    w = W.partitionBy("sentence_id")
    nth = F.row_number().over(w.orderBy(F.desc("revision_number")))
    return revisions.withColumn("_n", F.count("*").over(w)).withColumn("_at", nth).where((F.col("_n") >= raters) & (F.col("_at") <= raters)).drop("_n", "_at")


def entity_ratings(revisions: DataFrame) -> DataFrame:
    """(sentence_id, revision_number, item, category) of entity spans; the last of equal spans counts."""
    e = revisions.select("sentence_id", "revision_number", F.posexplode("entities").alias("at", "e"))
    key = F.concat_ws("|", F.coalesce("e.context_role", F.lit("current")), F.col("e.start"), F.col("e.end"), F.col("e.text"))
    return e.groupBy("sentence_id", "revision_number", key.alias("item")).agg(F.max_by("e.entity_type", "at").alias("category"))


def relation_ratings(revisions: DataFrame) -> DataFrame:
    """The same of relations, named by the spans at their ends; relations with a missing end don't count."""
    e = revisions.select("sentence_id", "revision_number", F.posexplode("entities").alias("at", "e"))
    key = F.concat_ws("|", F.coalesce("e.context_role", F.lit("current")), F.col("e.start"), F.col("e.end"), F.col("e.text"))
    ends = e.groupBy("sentence_id", "revision_number", F.col("e.client_id").alias("client_id")).agg(F.max_by(key, "at").alias("key"))
    r = revisions.select("sentence_id", "revision_number", F.posexplode("relations").alias("at", "r")).select(
        "sentence_id", "revision_number", "at", "r.source_client_id", "r.target_client_id", "r.relation_type"
    )
    for side in ("source", "target"):
        named = ends.select("sentence_id", "revision_number", F.col("client_id").alias(f"{side}_client_id"), F.col("key").alias(f"{side}_key"))
        r = r.join(named, ["sentence_id", "revision_number", f"{side}_client_id"])
    item = F.concat_ws(" -> ", "source_key", "target_key")
    return r.groupBy("sentence_id", "revision_number", item.alias("item")).agg(F.max_by("relation_type", "at").alias("category"))


def votes_of(ratings: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sentence_id, item, category, votes): each item of any chosen revision is rated by all of them.

    A revision without the item votes NONE, so the NONE votes are what the others leave of the number of
    revisions; nothing is joined against every revision.
    """
    raters = chosen.groupBy("sentence_id").agg(F.count("*").alias("raters"))
    counts = ratings.groupBy("sentence_id", "item", "category").agg(F.count("*").alias("votes"))
    present = counts.groupBy("sentence_id", "item").agg(F.sum("votes").alias("present")).join(raters, "sentence_id")
    none = present.where("present < raters").select("sentence_id", "item", F.lit("NONE").alias("category"), (F.col("raters") - F.col("present")).alias("votes"))
    both = counts.unionByName(none)
    return both.groupBy("sentence_id", "item", "category").agg(F.sum("votes").alias("votes"))


def sample_places(n: int, size: int, seed: int) -> list[int]:
    """Places of a seeded sample without replacement from ``n`` rows in order."""
    return sorted(random.Random(seed).sample(range(n), min(size, n)))


def agreement_report(revisions: DataFrame, raters: int = 2, size: int = 50, seed: int = 42) -> DataFrame:
    """([document_id,] scope, items, observed, expected, kappa, label) of each document's revisions for
    entities, relations and both.

    Sentences with at least ``raters`` revisions are eligible, whatever their status; a seeded sample of
    each document's own in ordinal order is rated by its latest revisions. ``revisions`` has ordinal,
    sentence_id, revision_number, entities, relations and document_id; without a document_id they are one
    document's. Sizes are 1 to 1000, raters 2 to 100.
    """
    if not 1 <= size <= 1000 or not 2 <= raters <= 100:
        raise ValueError("sample size is 1 to 1000, raters are 2 to 100")
    by = ["document_id"] if "document_id" in revisions.columns else []
    rev = revisions if by else revisions.withColumn("document_id", F.lit(""))
    kept = ["document_id", "ordinal", "sentence_id", "revision_number", "entities", "relations"]
    chosen = materialise(latest_revisions(rev, raters).select(*kept), "chosen")
    eligible = chosen.groupBy("sentence_id").agg(F.min("ordinal").alias("ordinal"), F.min("document_id").alias("document_id"))
    counts = eligible.groupBy("document_id").agg(F.count("*").alias("n"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(n: pd.Series) -> pd.Series:
        return n.map(lambda x: sample_places(x, size, seed))

    taken = counts.select("document_id", F.explode(places("n")).alias("place"))
    numbered = eligible.withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy("ordinal", "sentence_id")).cast("bigint") - 1)
    sample = numbered.join(taken, ["document_id", "place"]).select("sentence_id", "document_id")
    scopes = {"entity": votes_of(entity_ratings(chosen), chosen), "relation": votes_of(relation_ratings(chosen), chosen)}
    rows = [v.withColumn("scope", F.lit(k)) for k, v in scopes.items()]
    # a sentence's votes are its own, so the sample is taken from the votes, which are smaller than the revisions
    every = materialise(rows[0].unionByName(rows[1]).join(sample, "sentence_id"), "votes")
    every = every.unionByName(every.withColumn("item", F.concat_ws(" ", "scope", "item")).withColumn("scope", F.lit("overall")))
    votes = every.select(*by, "scope", F.concat_ws("/", "sentence_id", "item").alias("item"), "category", "votes")
    out = fleiss(votes, [*by, "scope"], raters)
    return out.withColumn("label", kappa_label(F.col("kappa")))
