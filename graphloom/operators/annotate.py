"""Annotation as an event log: saves append revisions, the current state is each sentence's last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.current import REVIEWED, latest
from graphloom.runtime import materialise

ENTITY = "struct<client_id:string,text:string,entity_type:string,start:int,end:int,context_role:string,source:string,decision:string>"
RELATION = "struct<source_client_id:string,target_client_id:string,relation_type:string,source:string>"


def revisions_of(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Save events (sentence_id, saved_at, status, entities, relations) as numbered revisions.

    Numbers go on from the highest existing one of the sentence. A skip holds neither entities nor
    relations.
    """
    if existing is None:
        base = events.withColumn("_last", F.lit(0))
    else:
        last = existing.groupBy("sentence_id").agg(F.max("revision_number").alias("_last"))
        base = events.join(last, "sentence_id", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    nth = F.row_number().over(W.partitionBy("sentence_id").orderBy("saved_at", "status"))
    skip = F.col("status") == "skipped"
    return base.select(
        "sentence_id",
        (F.col("_last") + nth).cast("int").alias("revision_number"),
        "status",
        F.when(skip, F.array().cast(f"array<{ENTITY}>")).otherwise(F.col("entities").cast(f"array<{ENTITY}>")).alias("entities"),
        F.when(skip, F.array().cast(f"array<{RELATION}>")).otherwise(F.col("relations").cast(f"array<{RELATION}>")).alias("relations"),
        "saved_at",
    )


def save_annotations(tables: dict[str, DataFrame], saves: DataFrame) -> dict[str, DataFrame]:
    """All tables after saves (sentence_id, saved_at, status, entities, relations).

    Every save is a revision; the last of a sentence becomes its state. Its earlier mentions and relations
    go, each entity becomes a mention with a canonical entity of its own, and canonical entities that only
    the earlier mentions pointed to go. A paper without an unreviewed sentence is completed. A skip saves
    nothing. Where a text isn't found at its place, or a relation names an entity that isn't saved, the
    jobs that read the result fail, so nothing of the batch is kept.
    """
    s, m, r, e = (tables[k] for k in ("sentences", "mentions", "relations", "entities"))
    fresh = revisions_of(saves, tables.get("revisions"))
    last = current_annotations(fresh)
    touched = last.select("sentence_id")
    base = F.concat_ws("-", "sentence_id", "revision_number")
    role = F.coalesce("e.context_role", F.lit("current"))
    told = s.select(F.col("id").alias("sentence_id"), F.col("text").alias("_now"), "context_before", "context_after").dropDuplicates(["sentence_id"])
    source = F.coalesce(F.when(role == "previous", F.col("context_before")).when(role == "next", F.col("context_after")).when(role == "current", F.col("_now")), F.lit(""))
    piece = F.when((F.col("e.start") >= 0) & (F.col("e.end") > F.col("e.start")), F.substring(source, F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))).otherwise("")
    text = F.when(piece == F.col("e.text"), F.col("e.text")).otherwise(F.raise_error(F.concat(F.lit("a text isn't at its place: "), F.coalesce("e.text", F.lit("")))))
    marked = last.join(told, "sentence_id").select("sentence_id", base.alias("base"), "context_before", "context_after", "_now", F.explode("entities").alias("e"))
    mention_id = F.concat_ws("-", "base", "e.client_id")
    named = marked.select(
        mention_id.alias("id"), "sentence_id", text.alias("text"), "e.entity_type", F.col("e.start").alias("start_offset"), F.col("e.end").alias("end_offset"),
        role.alias("context_role"), "e.source", "e.decision", F.concat(F.lit("c-"), mention_id).alias("canonical_entity_id"), F.col("e.client_id").alias("client_id"),
    )
    named = materialise(named, "saved")  # the checks are made here, before anything is replaced
    ends = named.select("sentence_id", "client_id", "id")
    links = last.select("sentence_id", base.alias("base"), F.posexplode("relations").alias("at", "r"))
    for side in ("source", "target"):
        one = ends.select("sentence_id", F.col("client_id").alias(f"_{side}"), F.col("id").alias(f"{side}_mention_id"))
        links = links.withColumn(f"_{side}", F.col(f"r.{side}_client_id")).join(one, ["sentence_id", f"_{side}"], "left")
    both = F.col("source_mention_id").isNotNull() & F.col("target_mention_id").isNotNull()
    linked = links.select(
        F.when(both, F.concat_ws("-", "base", F.concat(F.lit("r"), "at"))).otherwise(F.raise_error(F.lit("a relation names an entity that isn't saved"))).alias("id"),
        "sentence_id", "source_mention_id", "target_mention_id", "r.relation_type", "r.source",
    )
    linked = materialise(linked, "linked")
    out = dict(tables)
    left = m.join(touched, "sentence_id", "left_anti").select(*m.columns)
    out["mentions"] = left.unionByName(named.drop("client_id"), allowMissingColumns=True)
    out["relations"] = r.join(touched, "sentence_id", "left_anti").select(*r.columns).unionByName(linked, allowMissingColumns=True)
    before = m.join(touched, "sentence_id", "left_semi").where("canonical_entity_id is not null").select(F.col("canonical_entity_id").alias("id")).distinct()
    stale = before.join(left.select(F.col("canonical_entity_id").alias("id")), "id", "left_anti")
    own = named.select(F.col("canonical_entity_id").alias("id"), F.col("text").alias("preferred_name"), "entity_type", F.lit(None).cast("string").alias("description"), F.to_json(F.array("text")).alias("aliases_json"), F.lit(True).alias("active"))
    out["entities"] = e.join(stale, "id", "left_anti").unionByName(own, allowMissingColumns=True)
    status = last.select(F.col("sentence_id").alias("id"), F.col("status").alias("_saved"))
    out["sentences"] = s.join(status, "id", "left").withColumn("status", F.coalesce("_saved", "status")).select(*s.columns)
    asked = out["sentences"].join(touched.withColumnRenamed("sentence_id", "id"), "id", "left_semi").select("document_id").distinct()
    done = completed_documents(out["sentences"].join(asked, "document_id", "left_semi")).where("is_completed").select(F.col("document_id").alias("id"), F.lit("completed").alias("_done"))
    out["papers"] = tables["papers"].join(done, "id", "left").withColumn("status", F.coalesce("_done", "status")).select(*tables["papers"].columns)
    out["revisions"] = fresh if tables.get("revisions") is None else tables["revisions"].unionByName(fresh, allowMissingColumns=True)
    return out


def current_annotations(revisions: DataFrame) -> DataFrame:
    """The latest revision of each sentence."""
    return latest(revisions, "sentence_id", "revision_number")


def next_numbers(revisions: DataFrame) -> DataFrame:
    """(sentence_id, next_number): one more than the highest number."""
    return revisions.groupBy("sentence_id").agg((F.max("revision_number") + 1).alias("next_number"))


def span_checks(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """(id, sentence_id, is_valid): whether the text at a mention's place, in its sentence or neighbour, is its text.

    Places count code points, half-open. A role without text, a place outside it or a reversed one is invalid.
    """
    s = sentences.select(F.col("id").alias("sentence_id"), F.col("text").alias("sentence"), "context_before", "context_after")
    role = F.coalesce("context_role", F.lit("current"))
    source = F.when(role == "previous", F.col("context_before")).when(role == "next", F.col("context_after")).when(role == "current", F.col("sentence"))
    start, end = F.col("start_offset"), F.col("end_offset")
    piece = F.when((start >= 0) & (end > start), F.substring(source, start + 1, end - start))
    return mentions.join(s, "sentence_id").select("id", "sentence_id", F.coalesce(piece == F.col("text"), F.lit(False)).alias("is_valid"))


def repaired_spans(mentions: DataFrame, sentences: DataFrame, strict: bool = False) -> DataFrame:
    """(id, sentence_id, occurrences, start, end): mentions put where their text stands, where that is one place.

    A place that fits is kept. Else all occurrences in the text of the role are counted, overlapping ones
    too; with none or several the place is null, and with ``strict`` the job fails. Empty texts have none.
    """
    s = sentences.select(F.col("id").alias("sentence_id"), F.col("text").alias("_now"), "context_before", "context_after")
    role = F.coalesce("context_role", F.lit("current"))
    source = F.coalesce(F.when(role == "previous", F.col("context_before")).when(role == "next", F.col("context_after")).when(role == "current", F.col("_now")), F.lit(""))
    size = F.length("text")
    rows = mentions.join(s, "sentence_id").withColumn("_in", source)
    fits = (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset"))
    fits = F.coalesce(fits & (F.substring(F.col("_in"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("text")), F.lit(False))
    last = F.length("_in") - size
    found = F.when((size > 0) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(F.col("_in"), i + 1, size) == F.col("text"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_fits", fits).withColumn("_at", F.when(F.col("_fits"), F.array("start_offset")).otherwise(F.coalesce(found, F.array().cast("array<int>"))))
    wrong = F.raise_error(F.concat(F.lit("no one place for: "), F.coalesce("text", F.lit("")))) if strict else F.lit(None).cast("int")
    start = F.when(F.size("_at") == 1, F.get("_at", 0)).otherwise(wrong)
    end = F.when(F.col("_fits"), F.col("end_offset")).when(F.size("_at") == 1, F.get("_at", 0) + size)
    return rows.select("id", "sentence_id", F.size("_at").alias("occurrences"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def backfill(sentences: DataFrame, mentions: DataFrame, relations: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """First revisions of reviewed sentences that have none: their current mentions and relations.

    A skipped sentence's revision is empty; a relation is kept if both its mentions are. Run on its own
    result it adds nothing.
    """
    todo = sentences.where(F.col("status").isin(*REVIEWED)).select(F.col("id").alias("sentence_id"), "status").distinct()
    if revisions is not None:
        todo = todo.join(revisions.select("sentence_id"), "sentence_id", "left_anti")
    live = todo.where("status <> 'skipped'")
    kept = mentions.join(live.select("sentence_id"), "sentence_id", "left_semi")
    entity = F.struct(
        F.col("id").alias("client_id"), "text", "entity_type", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"),
        F.coalesce("context_role", F.lit("current")).alias("context_role"), "source", "decision",
    ).cast(ENTITY)
    entities = kept.groupBy("sentence_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    ends = kept.select(F.col("id").alias("mention_id"), "sentence_id")
    r = relations
    for side in ("source", "target"):
        r = r.join(ends.select(F.col("mention_id").alias(f"{side}_mention_id"), "sentence_id"), [f"{side}_mention_id", "sentence_id"], "left_semi")
    relation = F.struct(F.col("source_mention_id").alias("source_client_id"), F.col("target_mention_id").alias("target_client_id"), "relation_type", "source").cast(RELATION)
    linked = r.groupBy("sentence_id").agg(F.array_sort(F.collect_list(relation)).alias("relations"))
    return (
        todo.join(entities, "sentence_id", "left")
        .join(linked, "sentence_id", "left")
        .select(
            "sentence_id",
            F.lit(1).alias("revision_number"),
            "status",
            F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")).alias("entities"),
            F.coalesce("relations", F.array().cast(f"array<{RELATION}>")).alias("relations"),
        )
    )


def completed_documents(sentences: DataFrame) -> DataFrame:
    """(document_id, is_completed): whether no sentence is left unreviewed."""
    return sentences.groupBy("document_id").agg((F.count_if(~F.col("status").isin(*REVIEWED)) == 0).alias("is_completed"))


def earliest_open(sentences: DataFrame) -> DataFrame:
    """(document_id, ordinal): the first unreviewed sentence, the first of all where none is left."""
    return sentences.groupBy("document_id").agg(
        F.coalesce(F.min(F.when(~F.col("status").isin(*REVIEWED), F.col("ordinal"))), F.lit(0)).alias("ordinal")
    )


def highlighted(mentions: DataFrame) -> DataFrame:
    """(sentence_id, spans): non-overlapping mention spans in order, those that begin inside one before skipped."""
    spans = mentions.where("coalesce(context_role, 'current') = 'current' and end_offset > start_offset and start_offset >= 0")
    ordered = F.array_sort(F.collect_set(F.struct(F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))))
    kept = "array<struct<start: int, end: int>>"
    step = lambda acc, x: F.when(x["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(x))).otherwise(acc)
    return spans.groupBy("sentence_id").agg(ordered.alias("s")).select("sentence_id", F.aggregate("s", F.array().cast(kept), step).alias("spans"))


def new_suggestions(suggested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions that no existing row equals in the key columns, nulls equal to nulls."""
    cond = None
    right = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = same if cond is None else cond & same
    return suggested.join(right, cond, "left_anti")
