"""Machine suggestions held against text and ontology; nothing is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTED_ENTITY = "struct<local_id:string,text:string,entity_type:string,start:int,end:int>"
PREDICTED_RELATION = "struct<source_id:string,relation_type:string,target_id:string,evidence:string>"


def valid_entities(predicted: DataFrame, sentences: DataFrame, entity_types: DataFrame) -> DataFrame:
    """(sentence_id, local_id, text, entity_type, start, end) of predictions that can be anchored.

    A span that doesn't hold its text is moved to the text's only occurrence, counted without overlap;
    with none or several it is dropped, as are types outside ``entity_types`` (entity_type).
    """
    s = sentences.select(F.col("id").alias("sentence_id"), F.col("text").alias("sentence"))
    rows = predicted.join(s, "sentence_id").join(entity_types.select("entity_type").distinct(), "entity_type", "left_semi")
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    fits = (start >= 0) & (end > start) & (F.substring("sentence", start + 1, end - start) == text)
    times = (F.length("sentence") - F.length(F.replace(F.col("sentence"), text, F.lit("")))) / F.nullif(F.length(text), F.lit(0))
    place = F.expr("locate(text, sentence)") - 1
    ok = rows.withColumn("_fits", F.coalesce(fits, F.lit(False))).where(F.col("_fits") | (times == 1))
    return ok.select(
        "sentence_id", "local_id", "text", "entity_type",
        F.when(F.col("_fits"), start).otherwise(place).cast("int").alias("start"),
        F.when(F.col("_fits"), end).otherwise(place + F.length(text)).cast("int").alias("end"),
    )


def valid_relations(predicted: DataFrame, entities: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Predicted relations of a known type with both ends among the valid entities."""
    rows = predicted.join(relation_types.select("relation_type").distinct(), "relation_type", "left_semi")
    for side in ("source_id", "target_id"):
        rows = rows.join(entities.select("sentence_id", F.col("local_id").alias(side)).distinct(), ["sentence_id", side], "left_semi")
    return rows


def recommended_relations(relation_types: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_type, target_type, relation_type, is_recommended) for pairs of entity types.

    A relation fits where its subject list and its object list are empty or hold the type. The types of an
    ontology are few: each pair carries them as an array, so nothing is joined without a key.
    """
    every = relation_types.agg(F.collect_list(F.struct("relation_type", "subject_types", "object_types")).alias("r")).withColumn("_k", F.lit(1))
    rows = pairs.select("source_type", "target_type").distinct().withColumn("_k", F.lit(1)).join(F.broadcast(every), "_k")
    open_or = lambda types, t: (F.size(types) == 0) | F.array_contains(types, t)
    out = rows.select("source_type", "target_type", F.explode("r").alias("r"))
    fits = open_or(F.col("r.subject_types"), F.col("source_type")) & open_or(F.col("r.object_types"), F.col("target_type"))
    return out.select("source_type", "target_type", "r.relation_type", fits.alias("is_recommended"))


def suggest(sentences: DataFrame, extractor: Callable[[str, str | None, str | None, int], dict], run_index: int = 1) -> DataFrame:
    """(sentence_id, entities, relations) from an outside extractor, called once per sentence.

    ``extractor(sentence, before, after, run_index)`` returns {"entities": [...], "relations": [...]}.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extractor(t, b, a, run_index) for t, b, a in zip(batch["text"], batch["context_before"], batch["context_after"])]
            yield pd.DataFrame({"sentence_id": batch["id"], "entities": [f.get("entities", []) for f in found], "relations": [f.get("relations", []) for f in found]})

    rows = sentences.where("text is not null").select("id", "text", "context_before", "context_after")
    return rows.mapInPandas(run, f"sentence_id string, entities array<{PREDICTED_ENTITY}>, relations array<{PREDICTED_RELATION}>")


#: Places {entity_types}, {relation_types}, {context_before}, {sentence}, {context_after} and {run_index} are filled.
PROMPT = (
    "Mark entities and relations of the current sentence only, each with evidence in it.\n"
    "Entity types:\n{entity_types}\nRelation types:\n{relation_types}\n"
    "Before: {context_before}\nSentence: {sentence}\nAfter: {context_after}\nRun {run_index}.\n"
)


def prompts(sentences: DataFrame, entity_types: str, relation_types: str, run_index: int = 1, pattern: str = PROMPT, absent: str = "无") -> DataFrame:
    """(sentence_id, prompt): the template filled for each sentence; a missing neighbour reads ``absent``."""
    from graphloom.functions.text import template

    near = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(absent))
    filled = template(
        pattern, entity_types=F.lit(entity_types), relation_types=F.lit(relation_types), run_index=F.lit(run_index),
        context_before=near("context_before"), context_after=near("context_after"), sentence=F.col("text"),
    )
    return sentences.select(F.col("id").alias("sentence_id"), filled.alias("prompt"))
