"""Exports: JSON lines, triples as CSV, GEXF, cleaned artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialise


def sentence_lines(sentences: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ordinal, line): a JSON object per sentence, whatever its status, with its annotations."""
    e = F.struct("id", "text", "entity_type", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), "context_role", "source", "decision", "canonical_entity_id")
    r = F.struct("id", "source_mention_id", "target_mention_id", "relation_type", "source")
    entities = mentions.groupBy("sentence_id").agg(F.array_sort(F.collect_list(e)).alias("entities"))
    linked = relations.groupBy("sentence_id").agg(F.array_sort(F.collect_list(r)).alias("relations"))
    rows = sentences.withColumnRenamed("id", "sentence_id").join(entities, "sentence_id", "left").join(linked, "sentence_id", "left")
    body = F.struct(
        "sentence_id", "document_id", "ordinal", "page_number", "text", "status",
        F.coalesce("entities", F.array()).alias("entities"), F.coalesce("relations", F.array()).alias("relations"),
    )
    return rows.select("document_id", "ordinal", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(lines: DataFrame, path: str) -> None:
    """Lines in document and ordinal order."""
    lines.repartitionByRange("document_id").sortWithinPartitions("document_id", "ordinal").select("line").write.mode("overwrite").text(path)


def triples(sentences: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, sentence_id, page, subject, relation, object, evidence), relations with a missing end left out."""
    s = sentences.select(F.col("id").alias("sentence_id"), "document_id", F.col("page_number").alias("page"), F.col("text").alias("evidence"))
    named = lambda side, name: mentions.select(F.col("id").alias(f"{side}_mention_id"), F.col("text").alias(name))
    rows = relations.join(s, "sentence_id").join(named("source", "subject"), "source_mention_id").join(named("target", "object"), "target_mention_id")
    return rows.select("document_id", "sentence_id", "page", "subject", F.col("relation_type").alias("relation"), "object", "evidence")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def gexf_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, xml): a GEXF node element per node; documents default to 1."""
    documents = F.col("document_count") if "document_count" in nodes.columns else F.lit(1)
    value = lambda key, c: F.struct(F.lit(key).alias("_for"), c.cast("string").alias("_value"))
    values = F.array(
        value("entity_type", F.col("entity_type")), value("aliases", F.array_join("aliases", " | ")),
        value("mention_count", F.col("mention_count")), value("document_count", documents),
    )
    body = F.struct(F.col("node_id").alias("_id"), F.col("name").alias("_label"), F.struct(values.alias("attvalue")).alias("attvalues"))
    return nodes.select("node_id", F.to_xml(body, {"rowTag": "node", "indent": ""}).alias("xml"))


def gexf_edges(edges: DataFrame) -> DataFrame:
    """(edge_no, xml): a GEXF edge element per edge, numbered from 0 in key order, weighted by evidence.

    The numbers come from sorted partitions and their sizes, not from one global window.
    """
    keys = ["source_id", "relation_type", "target_id"]
    ordered = edges.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "evidence_count", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    # written once, so that the parts counted are the parts numbered
    ordered = materialise(ordered.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "edges")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row per partition
    before, starts = 0, {}
    for row in sorted(sizes, key=lambda r: r.part):
        starts[row.part] = before
        before += row.n
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    numbered = ordered.withColumn("edge_no", F.try_element_at(offset, F.col("part")) + F.col("at"))
    value = lambda key, c: F.struct(F.lit(key).alias("_for"), c.cast("string").alias("_value"))
    body = F.struct(
        F.col("edge_no").alias("_id"), F.col("source_id").alias("_source"), F.col("target_id").alias("_target"),
        F.col("relation_type").alias("_label"), F.col("evidence_count").alias("_weight"),
        F.struct(F.array(value("relation_type", F.col("relation_type")), value("evidence_count", F.col("evidence_count"))).alias("attvalue")).alias("attvalues"),
    )
    return numbered.select("edge_no", F.to_xml(body, {"rowTag": "edge", "indent": ""}).alias("xml"))


_ATTRIBUTES = {"node": (("entity_type", "string"), ("aliases", "string"), ("mention_count", "integer"), ("document_count", "integer")), "edge": (("relation_type", "string"), ("evidence_count", "integer"))}


def gexf_frame() -> tuple[str, str, str]:
    """What stands before the nodes, between nodes and edges, and after the edges."""
    kinds = "".join(
        f'<attributes class="{kind}">' + "".join(f'<attribute id="{n}" title="{n}" type="{t}"/>' for n, t in names) + "</attributes>"
        for kind, names in _ATTRIBUTES.items()
    )
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph mode="static" defaultedgetype="directed">{kinds}<nodes>'
    return head, "</nodes><edges>", "</edges></graph></gexf>"


def gexf_document(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> str:
    """A whole GEXF document of a graph a viewer can hold; larger graphs are written by parts."""
    n = gexf_nodes(nodes).orderBy("node_id").limit(most + 1).collect()
    e = gexf_edges(edges).orderBy("edge_no").limit(most + 1).collect()
    if len(n) > most or len(e) > most:
        raise ValueError("the graph is too large for one document; write gexf_nodes and gexf_edges")
    head, middle, tail = gexf_frame()
    return head + "".join(r.xml for r in n) + middle + "".join(r.xml for r in e) + tail


def block_artifacts(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(document_id, label_structure, label_structure_cleaned): a paper's gated blocks, and the merged ones, as JSON lists."""
    item = F.struct("page_number", "category", F.col("text").alias("content"), "bbox")
    out = None
    for blocks, name in ((raw, "label_structure"), (cleaned, "label_structure_cleaned")):
        ordered = F.array_sort(F.collect_list(F.struct("block_no", item.alias("item"))))
        text = F.to_json(F.transform(ordered, lambda x: x["item"]), {"ignoreNullFields": "false"})
        one = blocks.groupBy("document_id").agg(text.alias(name))
        out = one if out is None else out.join(one, "document_id", "left")
    return out
