"""Knowledge graphs from approved annotations, as node and edge tables with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import aliases_of, by_length, graph_key_of
from graphloom.operators.current import REVIEWED, mention_evidence

# Order in which a group's first member is found: paper, sentence, place, id.
_PLACE = ("document_id", "ordinal", "start_offset", "id")


def _place() -> Column:
    return F.struct(*_PLACE)


def approved_mentions(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions of approved sentences with their evidence."""
    return mention_evidence(mentions, sentences.where("status = 'approved'"))


def global_nodes(mentions: DataFrame, sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """(node_id, name, entity_type, aliases, mention_count, document_count) over all papers.

    A node is a canonical entity, active or not, or a mention without one. Name and type come from the
    canonical entity, else from the first member. Aliases are the members' texts and the canonical's names,
    shortest first.
    """
    m = approved_mentions(mentions, sentences).withColumn("node_id", F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id"))
    nodes = m.groupBy("node_id").agg(
        F.min_by("mention_text", _place()).alias("first_text"),
        F.min_by("entity_type", _place()).alias("first_type"),
        F.collect_set("mention_text").alias("texts"),
        F.count("*").alias("mention_count"),
        F.countDistinct("document_id").alias("document_count"),
    )
    known = entities.select(F.col("id").alias("node_id"), "preferred_name", F.col("entity_type").alias("known_type"), aliases_of(F.col("aliases_json")).alias("known_aliases"))
    names = F.array_compact(F.concat("texts", F.coalesce("known_aliases", F.array().cast("array<string>")), F.array("preferred_name")))
    return nodes.join(known, "node_id", "left").select(
        "node_id",
        F.coalesce("preferred_name", "first_text").alias("name"),
        F.coalesce("known_type", "first_type").alias("entity_type"),
        by_length(names).alias("aliases"),
        "mention_count",
        "document_count",
    )


def _ends(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations with both ends among ``members`` (mention_id, node_id); others fall away."""
    for side in ("source", "target"):
        named = members.select(F.col("mention_id").alias(f"{side}_mention_id"), F.col("node_id").alias(f"{side}_id"))
        relations = relations.join(named, f"{side}_mention_id")
    return relations


def global_edges(mentions: DataFrame, sentences: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_id, relation_type, target_id, evidence_count, document_count) over all papers."""
    s = sentences.where("status = 'approved'").select(F.col("id").alias("sentence_id"), "document_id")
    m = mentions.join(s.select("sentence_id"), "sentence_id", "left_semi")
    members = m.select(F.col("id").alias("mention_id"), F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id").alias("node_id"))
    return (
        _ends(relations.join(s, "sentence_id"), members)
        .groupBy("source_id", "relation_type", "target_id")
        .agg(F.count("*").alias("evidence_count"), F.countDistinct("document_id").alias("document_count"))
    )


def article_members(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Approved mentions with their key inside the paper and their node's id.

    A node is a type and a normalised text within one paper; its id is the first member's canonical
    entity, else that mention. Keys merged elsewhere may share an id; they stay nodes of their own.
    """
    m = approved_mentions(mentions, sentences).withColumn("node_key", graph_key_of(F.col("mention_text")))
    first = m.groupBy("document_id", "entity_type", "node_key").agg(
        F.min_by(F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id"), _place()).alias("node_id")
    )
    return m.join(first, ["document_id", "entity_type", "node_key"])


def article_nodes(mentions: DataFrame, sentences: DataFrame, evidence: bool = False) -> DataFrame:
    """(document_id, node_id, node_key, name, entity_type, aliases, mention_count[, evidence]) per paper."""
    m = article_members(mentions, sentences)
    found = F.struct(*_PLACE, "sentence_id", "page_number", "evidence", "context_role")
    extra = [F.array_sort(F.collect_list(found)).alias("evidence")] if evidence else []
    nodes = m.groupBy("document_id", "entity_type", "node_key", "node_id").agg(
        F.collect_set("mention_text").alias("texts"), F.count("*").alias("mention_count"), *extra
    )
    aliases = by_length(F.col("texts"))
    return nodes.select(
        "document_id", "node_id", "node_key", F.get(aliases, 0).alias("name"), "entity_type", aliases.alias("aliases"), "mention_count",
        *(["evidence"] if evidence else []),
    )


def article_edges(mentions: DataFrame, sentences: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, source_id, relation_type, target_id, evidence_count) per paper."""
    s = sentences.where("status = 'approved'").select(F.col("id").alias("sentence_id"), F.col("document_id").alias("paper"))
    members = article_members(mentions, sentences).select(F.col("id").alias("mention_id"), "node_id")
    return (
        _ends(relations.join(s, "sentence_id"), members)
        .groupBy(F.col("paper").alias("document_id"), "source_id", "relation_type", "target_id")
        .agg(F.count("*").alias("evidence_count"))
    )


def node_evidence(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row per approved mention of the global graph: its node, and the text it was found in."""
    m = approved_mentions(mentions, sentences)
    return m.select(
        F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id").alias("node_id"), F.col("id").alias("mention_id"), "document_id", "sentence_id", "page_number", "mention_text", "context_role", "evidence"
    )


def edge_evidence(mentions: DataFrame, sentences: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per relation of the global graph with the sentence it stands in."""
    s = sentences.where("status = 'approved'").select(F.col("id").alias("sentence_id"), "document_id", "page_number", F.col("text").alias("evidence"))
    m = mentions.join(s.select("sentence_id"), "sentence_id", "left_semi")
    members = m.select(F.col("id").alias("mention_id"), F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id").alias("node_id"))
    return _ends(relations.withColumnRenamed("id", "relation_id").join(s, "sentence_id"), members).select(
        "relation_id", "source_id", "relation_type", "target_id", "document_id", "sentence_id", "page_number", "evidence"
    )


def review_stats(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Counts of sentences, reviewed, approved and skipped ones per group."""
    return sentences.groupBy(*by).agg(
        F.count("*").alias("sentences"),
        F.count_if(F.col("status").isin(*REVIEWED)).alias("reviewed"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour_id): nodes one edge away in either direction, a node's own loops aside."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"))
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"))
    return out.unionByName(back).where("node_id <> neighbour_id").distinct()


def searched(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or type holds the trimmed query, whatever its case; an empty query finds all."""
    q = query.strip().lower()
    return nodes.where(F.lower("name").contains(q) | F.lower("entity_type").contains(q)) if q else nodes


def top_nodes(nodes: DataFrame, n: int = 160) -> DataFrame:
    """The ``n`` nodes with the most mentions, by id where equal."""
    return nodes.orderBy(F.desc("mention_count"), "node_id").limit(n)


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for side in ("source_id", "target_id"):
        edges = edges.join(nodes.select(F.col("node_id").alias(side)).distinct(), side, "left_semi")
    return edges


def layout(nodes: DataFrame, edges: DataFrame, rounds: int = 90, seed: int = 0) -> DataFrame:
    """(node_id, x, y): a force-directed layout of a drawn graph of at most a few hundred nodes."""
    import numpy as np

    ids = sorted(r.node_id for r in nodes.select("node_id").limit(1001).collect())
    if len(ids) > 1000:
        raise ValueError("a drawing takes at most 1000 nodes")
    place = {k: i for i, k in enumerate(ids)}
    pairs = [(place[r.source_id], place[r.target_id]) for r in edges_within(edges, nodes).select("source_id", "target_id").distinct().collect()]  # between at most 1000 nodes
    rng = np.random.default_rng(seed)
    at = rng.uniform(-1, 1, (len(ids), 2))
    for k in range(rounds):
        gap = at[:, None] - at[None]
        far = np.maximum((gap**2).sum(-1), 1e-4)
        move = (gap / far[..., None]).sum(1) / max(len(ids), 1)
        for a, b in pairs:
            pull = at[b] - at[a]
            move[a] += 0.5 * pull
            move[b] -= 0.5 * pull
        at = at + np.clip(move, -0.5, 0.5) * (1 - k / rounds) * 0.2
    rows = [(i, float(x), float(y)) for i, (x, y) in zip(ids, at)]
    return nodes.sparkSession.createDataFrame(rows, "node_id string, x double, y double")


def drawn_order(nodes: DataFrame) -> DataFrame:
    """Nodes numbered for drawing, by mentions."""
    return nodes.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("mention_count"), "node_id")))  # after top_nodes
