import json
import random
import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from graphloom.operators import agreement, annotate, embed, graph, maintain, resolve, suggest
from graphloom.sources import sinks
from graphloom.streaming.events import annotation_stream, current_state

SENTENCE = "id string, document_id string, ordinal int, page_number int, text string, context_before string, context_after string, status string"
MENTION = "id string, sentence_id string, text string, entity_type string, start_offset int, end_offset int, context_role string, source string, decision string, canonical_entity_id string"
RELATION = "id string, sentence_id string, source_mention_id string, target_mention_id string, relation_type string, source string"
ENTITY = "id string, preferred_name string, entity_type string, description string, aliases_json string, active boolean"
CANDIDATE = "id string, left_entity_id string, right_entity_id string, total_score double, status string"


@pytest.fixture(scope="module")
def data(spark):
    s = spark.createDataFrame(
        [
            ("s1", "d1", 0, 1, "Zinc melts.", None, "It boils.", "approved"),
            ("s2", "d1", 1, 1, "It boils.", "Zinc melts.", None, "skipped"),
            ("s3", "d2", 0, 2, "zinc & tin", "", None, "approved"),
            ("s4", "d2", 1, 2, "open", None, None, "pending"),
        ],
        SENTENCE,
    )
    m = spark.createDataFrame(
        [
            ("m1", "s1", "Zinc", "T", 0, 4, "current", "manual", "accepted", "e1"),
            ("m2", "s1", "boils", "P", 3, 8, "next", "manual", "accepted", "e2"),
            ("m3", "s3", "zinc", "T", 0, 4, None, "manual", "accepted", "e1"),
            ("m4", "s3", "tin", "T", 7, 10, "previous", "manual", "accepted", None),
            ("m5", "s4", "open", "T", 0, 4, "current", "manual", "accepted", "e9"),
            ("m6", "s1", "ZINC", "T", 0, 5, "current", "manual", "accepted", ""),
        ],
        MENTION,
    )
    r = spark.createDataFrame([("r1", "s1", "m1", "m2", "HAS", "manual"), ("r2", "s3", "m3", "m4", "WITH", "manual"), ("r3", "s3", "m3", "gone", "WITH", "manual"), ("r4", "s1", "m1", "m2", "HAS", "manual")], RELATION)
    e = spark.createDataFrame([("e1", "Zinc metal", "Material", None, '["Zn"]', False), ("e2", "boiling", "Process", None, "broken", True), ("e9", "open", "T", None, None, True)], ENTITY)
    return s, m, r, e


def test_global_graph(data):
    s, m, r, e = data
    nodes = {x.node_id: x for x in graph.global_nodes(m, s, e).collect()}
    assert nodes["e1"].name == "Zinc metal" and nodes["e1"].aliases == ["Zn", "Zinc", "zinc", "Zinc metal"]
    assert (nodes["e1"].mention_count, nodes["e1"].document_count) == (2, 2)
    assert nodes["m4"].name == "tin" and "e9" not in nodes and nodes["m6"].name == "ZINC"
    edges = {tuple(x) for x in graph.global_edges(m, s, r).collect()}
    assert edges == {("e1", "HAS", "e2", 2, 1), ("e1", "WITH", "m4", 1, 1)}
    assert {tuple(x) for x in graph.neighbours(graph.global_edges(m, s, r)).collect()} == {("e1", "e2"), ("e2", "e1"), ("e1", "m4"), ("m4", "e1")}


def test_article_graph(data):
    s, m, r, e = data
    nodes = graph.article_nodes(m, s, evidence=True).collect()
    zinc = next(x for x in nodes if x.document_id == "d1" and x.entity_type == "T")
    assert zinc.node_id == "e1" and zinc.mention_count == 2 and zinc.aliases == ["ZINC", "Zinc"] and zinc.name == "ZINC"
    assert {x["evidence"] for n in nodes if n.node_key == "boils" for x in n.evidence} == {"It boils."}
    tin = next(x for x in nodes if x.node_key == "tin")
    assert tin.evidence[0]["evidence"] == "zinc & tin"  # an empty neighbour gives way
    assert {tuple(x) for x in graph.article_edges(m, s, r).collect()} == {("d1", "e1", "HAS", "e2", 2), ("d2", "e1", "WITH", "m4", 1)}


def test_empty_tables(data):
    s, m, r, e = (x.limit(0) for x in data)
    for df in (graph.global_nodes(m, s, e), graph.global_edges(m, s, r), graph.article_nodes(m, s), annotate.backfill(s, m, r), annotate.span_checks(m, s), sinks.triples(s, m, r), resolve.auto_merges(e), maintain.unreferenced(e, m), annotate.highlighted(m)):
        assert df.count() == 0


def test_exports(data):
    s, m, r, e = data
    nodes, edges = graph.global_nodes(m, s, e), graph.global_edges(m, s, r)
    root = ET.fromstring(sinks.gexf_document(nodes, edges).encode())
    ns = "{http://gexf.net/1.3}"
    found = {n.get("id"): n for n in root.iter(f"{ns}node")}
    assert found["e1"].get("label") == "Zinc metal"
    values = {v.get("for"): v.get("value") for v in found["e1"].iter(f"{ns}attvalue")}
    assert values == {"entity_type": "Material", "aliases": "Zn | Zinc | zinc | Zinc metal", "mention_count": "2", "document_count": "2"}
    assert sorted(x.get("id") for x in root.iter(f"{ns}edge")) == ["0", "1"] and {x.get("weight") for x in root.iter(f"{ns}edge")} == {"1", "2"}
    lines = [json.loads(x.line) for x in sinks.sentence_lines(s, m, r).orderBy("document_id", "ordinal").collect()]
    assert len(lines) == 4 and [x["id"] for x in lines[0]["entities"]] == ["m1", "m2", "m6"] and lines[3]["relations"] == []
    assert sinks.triples(s, m, r).count() == 3


def test_listing(data):
    s, m, _, _ = data
    assert {tuple(x) for x in annotate.earliest_open(s).collect()} == {("d1", 0), ("d2", 1)}
    assert {tuple(x) for x in annotate.completed_documents(s).collect()} == {("d1", True), ("d2", False)}
    checks = {x.id: x.is_valid for x in annotate.span_checks(m, s).collect()}
    assert checks == {"m1": True, "m2": True, "m3": True, "m4": False, "m5": True, "m6": False}


def test_code_points(spark):
    s = spark.createDataFrame([("s", "d", 0, 1, "😀abc", None, None, "approved")], SENTENCE)
    m = spark.createDataFrame([("m", "s", "a", "T", 1, 2, "current", "manual", "accepted", None)], MENTION)
    assert annotate.span_checks(m, s).first().is_valid


def test_highlights_against_a_sequential_model(spark):
    r = random.Random(2)
    rows = [(f"m{i}", f"s{i % 20}", "x", "T", a := r.randint(0, 12), a + r.randint(0, 5), "current", "m", "a", None) for i in range(150)]
    got = {x.sentence_id: [(y["start"], y["end"]) for y in x.spans] for x in annotate.highlighted(spark.createDataFrame(rows, MENTION)).collect()}
    want = {}
    for s in {x[1] for x in rows}:
        end, kept = 0, []
        for a, b in sorted({(x[4], x[5]) for x in rows if x[1] == s and x[5] > x[4]}):
            if a >= end:
                kept.append((a, b))
                end = b
        if kept:
            want[s] = kept
    assert got == want


def test_revisions_and_backfill(spark, data):
    s, m, r, _ = data
    first = annotate.backfill(s, m, r)
    rows = {x.sentence_id: x for x in first.collect()}
    assert set(rows) == {"s1", "s2", "s3"} and rows["s2"].entities == [] and len(rows["s1"].relations) == 2 and len(rows["s3"].relations) == 1
    assert annotate.backfill(s, m, r, first).count() == 0
    ev = spark.createDataFrame([("s1", 1, "approved"), ("s1", 2, "skipped"), ("s9", 1, "approved")], "sentence_id string, saved_at int, status string")
    from pyspark.sql import functions as F

    ev = ev.withColumn("entities", F.array().cast(f"array<{annotate.ENTITY}>")).withColumn("relations", F.array().cast(f"array<{annotate.RELATION}>"))
    numbered = annotate.revisions_of(ev, first)
    assert {(x.sentence_id, x.revision_number) for x in numbered.collect()} == {("s1", 2), ("s1", 3), ("s9", 1)}
    assert {x.next_number for x in annotate.next_numbers(numbered).collect()} == {4, 2}


def fleiss_model(items, raters):
    n = len(items)
    po = sum((sum(v * v for v in c.values()) - raters) / (raters * (raters - 1)) for c in items) / n
    total = Counter()
    for c in items:
        total.update(c)
    pe = sum((v / (n * raters)) ** 2 for v in total.values())
    return n, round(po, 6), round(pe, 6), None if abs(1 - pe) < 1e-12 else round((po - pe) / (1 - pe), 6)


def votes(spark, items):
    return spark.createDataFrame([(i, k, v) for i, c in enumerate(items) for k, v in c.items()], "item int, category string, votes bigint")


def test_kappa(spark):
    unanimous = [{"A": 3}, {"B": 3}, {"C": 3}]
    assert agreement.fleiss(votes(spark, unanimous), [], 3).first().kappa == 1.0
    r = random.Random(5)
    items = [Counter(r.choice("ABC") for _ in range(3)) for _ in range(40)]
    assert tuple(agreement.fleiss(votes(spark, items), [], 3).first()) == pytest.approx(fleiss_model(items, 3), abs=2e-6)
    assert agreement.fleiss(votes(spark, [{"A": 3}, {"A": 3}]), [], 3).first().kappa is None
    assert agreement.fleiss(votes(spark, items).limit(0), [], 3).count() == 0
    with pytest.raises(Exception, match="number of raters"):
        agreement.fleiss(votes(spark, [{"A": 2}]), [], 3).collect()
    present = spark.createDataFrame([(1, 3), (2, 3), (3, 0), (4, 0)], "item int, present bigint")
    row = agreement.fleiss(agreement.binary_votes(present, 3).where("votes > 0"), [], 3).first()
    assert (row.kappa, row.observed, row.expected) == (1.0, 1.0, 0.5)


def test_report(spark):
    from pyspark.sql import functions as F

    ent = lambda t: [{"client_id": "c", "text": "x", "entity_type": t, "start": 0, "end": 1, "context_role": None, "source": "m", "decision": "m"}]
    rows = [(f"s{i}", i, n, ent("A" if n < 3 else "B"), []) for i in range(12) for n in range(1, 4)]
    rev = spark.createDataFrame(rows, f"sentence_id string, ordinal int, revision_number int, entities array<{annotate.ENTITY}>, relations array<{annotate.RELATION}>")
    out = {x.scope: x for x in agreement.agreement_report(rev, raters=3, size=5).collect()}
    assert out["entity"].items == 5 and out["entity"].observed == pytest.approx(1 / 3, abs=1e-6) and "relation" not in out
    assert agreement.sample_places(10, 3, 42) == sorted(random.Random(42).sample(range(10), 3))
    with pytest.raises(ValueError):
        agreement.agreement_report(rev, raters=1)
    assert rev.where(F.lit(False)).count() == 0


def hash_model(text):
    v = [0.0] * 256
    for b in embed.buckets(text):
        v[b] += 1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def test_vectors(spark):
    df = spark.createDataFrame([("a", "Zinc Oxide"), ("b", "zinc oxide"), ("c", "entirely other"), ("d", None), ("e", "")], "id string, text string")
    out = {x.id: x.embedding for x in embed.dense_vectors(df).collect()}
    assert out["a"] == pytest.approx(hash_model("Zinc Oxide")) and out["a"] == pytest.approx(out["b"])
    assert sum(x * y for x, y in zip(out["a"], out["c"])) < 0.5 and "d" not in out and len(out["e"]) == 256
    got = embed.with_provider(df, lambda t: [[float(len(x))] for x in t], dimensions=1)
    assert {x.id: x.embedding for x in got.collect()}["a"] == [10.0]


def test_similar_pairs_are_all_found(spark):
    r = random.Random(8)
    words = ["oxide", "glass", "alloy", "coating", "zinc", "copper", "doped"]
    named = [(f"e{i:03}", r.choice("TU"), " ".join(r.choices(words, k=2)) + r.choice(["", " a", " b2"])) for i in range(120)]
    vec = embed.sparse_vectors(spark.createDataFrame(named, "id string, entity_type string, text string"))
    got = {(x.left_id, x.right_id) for x in resolve.similar_pairs(vec, 0.8).collect()}
    dense = {i: hash_model(t) for i, _, t in named}
    want = {(a[0], b[0]) for a in named for b in named if a[0] < b[0] and a[1] == b[1] and sum(x * y for x, y in zip(dense[a[0]], dense[b[0]])) >= 0.8}
    assert got == want and want


def test_merge_scores_and_decisions(spark):
    e = spark.createDataFrame([("e1", "Zinc oxide", "T", None, '["ZnO"]', True), ("e2", "zinc-oxide", "T", None, "[]", True), ("e3", "Zinc oxide", "T", None, None, True), ("e4", "Zinc oxide", "U", None, None, True), ("e5", "Zinc oxides", "T", None, None, True), ("e6", "Zinc oxide", "T", None, None, False), ("e7", None, "T", None, None, True)], ENTITY)
    ctx = e.selectExpr("id", "coalesce(preferred_name, '') as context")
    pairs = {(x.left_entity_id, x.right_entity_id): x for x in resolve.scored_pairs(e, ctx, candidate=0.75).collect()}
    assert {("e1", "e2"), ("e1", "e3")} <= set(pairs) and all(pairs[k].total_score == 1 for k in (("e1", "e2"), ("e1", "e3")))
    assert not any("e4" in k or "e6" in k for k in pairs) and ("e1", "e5") in pairs
    assert {tuple(x) for x in resolve.auto_merges(e).collect()} == {("e3", "e1")}
    no = spark.createDataFrame([("e3", "e1")], "left_entity_id string, right_entity_id string")
    assert resolve.auto_merges_with_rejected(e, no).count() == 0
    assert ("e1", "e3") not in {(x.left_entity_id, x.right_entity_id) for x in resolve.scored_pairs(e, ctx, no).collect()}
    with pytest.raises(ValueError):
        resolve.check_thresholds(0.5, 0.6)
    c = spark.createDataFrame([("c1", "e1", "e2", 0.9, "pending"), ("c2", "e5", "e2", 0.8, "pending"), ("c3", "e2", "e5", 0.8, "deferred"), ("c4", "e1", "gone", 0.7, "pending")], CANDIDATE)
    d = spark.createDataFrame([("c1", "merge", "zinc-oxide")], "id string, decision string, preferred_name string")
    after, merges = resolve.decide(c, d, e)
    assert {x.id: x.status for x in after.collect()} == {"c1": "merged", "c2": "superseded", "c3": "deferred", "c4": "pending"}
    merged = {x.id: x for x in resolve.merged_entities(e, merges).collect()}
    assert merged["e1"].preferred_name == "zinc-oxide" and json.loads(merged["e1"].aliases_json) == ["Zinc oxide", "ZnO", "zinc-oxide"] and not merged["e2"].active
    m = spark.createDataFrame([("m", "s", "x", "T", 0, 1, "current", "m", "a", "e2")], MENTION)
    assert resolve.repointed(m, merges).first().canonical_entity_id == "e1"
    for bad in (("c1", "merge", "wrong"), ("c1", "what", None), ("c4", "merge", "x")):
        with pytest.raises(Exception):
            resolve.decide(c, spark.createDataFrame([bad], "id string, decision string, preferred_name string"), e)[0].collect()
    assert [x.id for x in resolve.queue(c, e).collect()] == ["c1", "c2", "c3"]


def test_chains_of_merges_end_at_their_last_survivor(spark):
    e = spark.createDataFrame([("a", "A", "T", None, '["x"]', True), ("b", "B", "T", None, None, True), ("c", "C", "T", None, '["y"]', True), ("d", "D", "T", None, "[]", True)], ENTITY)
    merges = spark.createDataFrame([("b", "a", None), ("c", "b", "C"), ("d", "c", None)], "id string, survivor_id string, preferred_name string")
    assert {tuple(x) for x in resolve.final_survivors(merges).collect()} == {("b", "a"), ("c", "a"), ("d", "a")}
    got = {x.id: x for x in resolve.merged_entities(e, merges).collect()}
    assert json.loads(got["a"].aliases_json) == ["A", "B", "C", "D", "x", "y"] and [k for k, x in got.items() if x.active] == ["a"]
    m = spark.createDataFrame([("m", "s", "x", "T", 0, 1, "current", "m", "a", "d")], MENTION)
    assert resolve.repointed(m, merges).first().canonical_entity_id == "a"
    assert resolve.final_survivors(merges.limit(0)).count() == 0
    with pytest.raises(ValueError):
        resolve.final_survivors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, survivor_id string"))


@pytest.mark.parametrize("seed", range(4))
def test_merges_with_rejections_equal_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    names = {f"e{i:02}": r.choice(["zinc", "oxide"]) for i in range(24)}
    ids = sorted(names)
    no = {tuple(sorted(r.sample(ids, 2))) for _ in range(60)}
    gone: dict = {}
    for a in ids:
        for b in ids:
            if a < b and a not in gone and b not in gone and names[a] == names[b] and (a, b) not in no:
                gone[b] = a
    e = spark.createDataFrame([(i, n, "T", None, None, True) for i, n in names.items()], ENTITY)
    rejected = spark.createDataFrame([(b, a) for a, b in no], "left_entity_id string, right_entity_id string")
    assert {tuple(x) for x in resolve.auto_merges_with_rejected(e, rejected).collect()} == set(gone.items())


def test_delete(spark, data):
    s, m, r, e = data
    papers = spark.createDataFrame([("d1",), ("d2",)], "id string")
    c = spark.createDataFrame([("c1", "e1", "e2", 0.9, "pending"), ("c2", "e1", "e9", 0.9, "pending")], CANDIDATE)
    tables = {"papers": papers, "sentences": s, "mentions": m, "relations": r, "entities": e, "candidates": c}
    out, counts = maintain.delete_documents(tables, spark.createDataFrame([("d1",)], "document_id string"))
    assert {x.kind: x.removed for x in counts.collect()} == {"sentences": 2, "mentions": 3, "entities": 1}
    assert {x.id for x in out["entities"].collect()} == {"e1", "e9"} and {x.id for x in out["candidates"].collect()} == {"c2"}
    assert {x.id for x in out["relations"].collect()} == {"r2", "r3"} and out["papers"].count() == 1


def test_suggestions(spark, data):
    s = data[0]
    p = spark.createDataFrame([("s1", "a", "Zinc", "T", 0, 4), ("s1", "b", "melts", "T", 0, 2), ("s1", "c", "none", "T", 0, 4), ("s1", "d", "Zinc", "X", 0, 4), ("s3", "e", "n", "T", 50, 51)], "sentence_id string, local_id string, text string, entity_type string, start int, end int")
    types = spark.createDataFrame([("T",)], "entity_type string")
    good = suggest.valid_entities(p, s, types)
    assert {(x.local_id, x.start, x.end) for x in good.collect()} == {("a", 0, 4), ("b", 5, 10)}
    rel = spark.createDataFrame([("s1", "a", "R", "b"), ("s1", "a", "R", "c"), ("s1", "a", "Q", "b")], "sentence_id string, source_id string, relation_type string, target_id string")
    assert suggest.valid_relations(rel, good, spark.createDataFrame([("R",)], "relation_type string")).count() == 1
    o = spark.createDataFrame([("R", ["T"], []), ("S", ["P"], ["T"]), ("W", [], [])], "relation_type string, subject_types array<string>, object_types array<string>")
    pair = spark.createDataFrame([("T", "P")], "source_type string, target_type string")
    assert {x.relation_type: x.is_recommended for x in suggest.recommended_relations(o, pair).collect()} == {"R": True, "S": False, "W": True}
    got = suggest.suggest(s, lambda t, b, a, n: {"entities": [{"local_id": "1", "text": t[:1], "entity_type": "T", "start": 0, "end": 1}]}).collect()
    assert len(got) == 4 and all(len(x.entities) == 1 and x.relations == [] for x in got)
    assert "Before: 无" in suggest.prompts(s, "T", "R").where("sentence_id = 's3'").first().prompt


def test_stream_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = {"sentence_id": "s1", "saved_at": "2026-01-01T00:00:00Z", "status": "approved", "entities": [], "relations": []}
    (inbox / "a.json").write_text(json.dumps(line) + "\n")
    args = (str(inbox), str(tmp_path / "rev"), str(tmp_path / "cur"), str(tmp_path / "ck"))
    annotation_stream(spark, *args).awaitTermination()
    (inbox / "b.json").write_text(json.dumps(line | {"status": "skipped", "saved_at": "2026-01-02T00:00:00Z"}) + "\n")
    annotation_stream(spark, *args).awaitTermination()
    annotation_stream(spark, *args).awaitTermination()
    assert {(x.revision_number, x.status) for x in spark.read.parquet(args[1]).collect()} == {(1, "approved"), (2, "skipped")}
    assert [(x.revision_number, x.status) for x in current_state(spark, args[2]).collect()] == [(2, "skipped")]
    assert current_state(spark, args[2], 1).first().status == "approved" and current_state(spark, args[2], 0) is None


def test_layout_and_search(data):
    s, m, r, e = data
    nodes, edges = graph.global_nodes(m, s, e), graph.global_edges(m, s, r)
    assert {x.node_id for x in graph.searched(nodes, " ZINC ").collect()} == {"e1", "m6"}
    assert graph.searched(nodes, " ").count() == nodes.count()
    top = graph.top_nodes(nodes, 1)
    assert top.first().node_id == "e1" and graph.edges_within(edges, top).count() == 0
    assert graph.layout(nodes, edges, rounds=5).count() == nodes.count()


def test_dense_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 40)
    r = random.Random(5)
    rows = [(i, r.choice("ab"), [r.gauss(1 if i % 3 else -1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(900, "a", None), (901, "a", [0.0] * 6), (902, None, [1.0] * 6), (903, "b", [1.0, None] * 3)]
    df = spark.createDataFrame(rows, "id bigint, label string, embedding array<double>")
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = {(a[0], b[0]) for a in rows[:300] for b in rows[:300] if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.7}
    got = resolve.dense_pairs(df, "label", 0.7).collect()
    assert {(x.left_id, x.right_id) for x in got} == want and len(got) == len(want)
    assert resolve.dense_pairs(df.limit(0), "label", 0.7).count() == 0


def test_a_save_replaces_a_sentence_as_a_whole(spark):
    s = spark.createDataFrame([("s1", "d1", 0, "zinc grew", None, "it held", "pending"), ("s2", "d1", 1, "it held", "zinc grew", None, "approved"), ("s3", "d2", 0, "no", None, None, "pending")], "id string, document_id string, ordinal int, text string, context_before string, context_after string, status string")
    m = spark.createDataFrame([("m1", "s1", "zinc", "T", 0, 4, "current", "m", "a", "e1"), ("m2", "s2", "it", "T", 0, 2, "current", "m", "a", "e2"), ("m3", "s1", "grew", "T", 5, 9, "current", "m", "a", "e2")], MENTION)
    rel = spark.createDataFrame([("r1", "s1", "m1", "m3", "R", "m")], "id string, sentence_id string, source_mention_id string, target_mention_id string, relation_type string, source string")
    e = spark.createDataFrame([("e1", "zinc", "T", None, None, True), ("e2", "it", "T", None, None, True)], ENTITY)
    p = spark.createDataFrame([("d1", "reviewable"), ("d2", "reviewable")], "id string, status string")
    tables = {"sentences": s, "mentions": m, "relations": rel, "entities": e, "papers": p}
    kind = f"sentence_id string, saved_at timestamp, status string, entities array<{annotate.ENTITY}>, relations array<{annotate.RELATION}>"

    def saved(status, entities, relations):
        import datetime

        return annotate.save_annotations(tables, spark.createDataFrame([("s1", datetime.datetime(2024, 1, 1), status, entities, relations)], kind))

    two = [("a", "zinc", "M", 0, 4, "current", "manual", "manual"), ("b", "held", "M", 3, 7, "next", "manual", "manual")]
    out = saved("approved", two, [("a", "b", "R2", "manual")])
    assert {(x.id, x.canonical_entity_id) for x in out["mentions"].collect()} == {("m2", "e2"), ("s1-1-a", "c-s1-1-a"), ("s1-1-b", "c-s1-1-b")}
    assert {(x.id, x.aliases_json) for x in out["entities"].collect()} == {("e2", None), ("c-s1-1-a", '["zinc"]'), ("c-s1-1-b", '["held"]')}
    assert [tuple(x)[:4] for x in out["relations"].collect()] == [("s1-1-r0", "s1", "s1-1-a", "s1-1-b")]
    assert {(x.id, x.status) for x in out["papers"].collect()} == {("d1", "completed"), ("d2", "reviewable")} and out["revisions"].first().revision_number == 1
    skipped = saved("skipped", two, [("a", "b", "R2", "manual")])
    assert [x.id for x in skipped["mentions"].collect()] == ["m2"] and skipped["relations"].count() == 0 and [x.id for x in skipped["entities"].collect()] == ["e2"]
    for entities, relations in (([("a", "zink", "M", 0, 4, "current", "manual", "manual")], []), (two, [("a", "x", "R", "manual")])):
        with pytest.raises(Exception):
            saved("approved", entities, relations)


def test_repaired_spans(spark):
    s = spark.createDataFrame([("s1", "d", 0, "aaa b", "ab ab", None, "pending")], "id string, document_id string, ordinal int, text string, context_before string, context_after string, status string")
    rows = [("m1", "b", 0, 1, None), ("m2", "aa", 3, 5, "current"), ("m3", "aa", 1, 3, "current"), ("m4", "ab", 1, 2, "previous"), ("m5", "x", 0, 1, "next"), ("m6", "", 0, 0, "current"), ("m7", None, 0, 1, "current"), ("m8", "aaa b", 2, 3, "current")]
    m = spark.createDataFrame([(i, "s1", t, "T", a, b, role, "m", "a", None) for i, t, a, b, role in rows], MENTION)
    got = {x.id: (x.occurrences, x.start, x.end) for x in annotate.repaired_spans(m, s).collect()}
    assert got == {"m1": (1, 4, 5), "m2": (2, None, None), "m3": (1, 1, 3), "m4": (2, None, None), "m5": (0, None, None), "m6": (0, None, None), "m7": (0, None, None), "m8": (1, 0, 5)}
    with pytest.raises(Exception):
        annotate.repaired_spans(m.where("id = 'm2'"), s, strict=True).collect()


def test_files_and_replacement(spark):
    p = spark.createDataFrame([("d1", "a.pdf"), ("d1", "a.pdf"), ("d2", None), ("d3", "c.pdf")], "id string, storage_path string")
    s = spark.createDataFrame([("s1", "d1"), ("s2", "d3")], "id string, document_id string")
    assets = spark.createDataFrame([("s1", "f1.png"), ("s1", "f1.png"), ("s2", "f2.png")], "sentence_id string, image_path string")
    gone = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    assert sorted(tuple(x) for x in maintain.files_of(p, gone, assets, s).collect()) == [("d1", "a.pdf"), ("d1", "f1.png")]
    fresh = spark.createDataFrame([("n1", "d1")], "id string, document_id string")
    assert sorted(x.id for x in maintain.replace_document(s, fresh).collect()) == ["n1", "s2"]
    assert [x.context_role for x in maintain.with_context_role(s).collect()] == ["current"] * 2


def test_text_sinks_read_back(spark, tmp_path):
    lines = spark.createDataFrame([("d2", 0, "z"), ("d1", 1, "b"), ("d1", 0, "a")], "document_id string, ordinal int, line string")
    sinks.write_jsonl(lines, str(tmp_path / "l"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b", "z"]
    rows = spark.createDataFrame([("x,y", 'say "so"'), (None, "2")], "a string, b string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert sorted(map(tuple, back), key=str) == sorted([("x,y", 'say "so"'), (None, "2")], key=str)
