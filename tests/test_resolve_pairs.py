"""Scored pairs against the loop over all pairs."""

import random

from graphloom.functions.names import resolution_key
from graphloom.operators import embed, resolve

ENTITY = "id string, preferred_name string, entity_type string, description string, aliases_json string, active boolean"


def vector(text):
    v = [0.0] * 256
    for b in embed.buckets(text):
        v[b] += 1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def loop(entities, contexts, rejected, candidate=0.85, auto=0.99):
    """{(left, right): (total, merged)} of the pairs the loop keeps, and those merged away."""
    rejected = {tuple(sorted(x)) for x in rejected}
    rows = sorted(entities)
    name, context = {i: vector(n) for i, n, _ in rows}, {i: vector(contexts[i]) for i, _, _ in rows}
    scored = []
    for at, (a, x, t) in enumerate(rows):
        for b, y, u in rows[at + 1 :]:
            if t != u or (a, b) in rejected:
                continue
            total = 0.7 * sum(p * q for p, q in zip(name[a], name[b])) + 0.3 * sum(p * q for p, q in zip(context[a], context[b]))
            total = 1.0 if resolution_key(x) == resolution_key(y) else total
            if total >= candidate:
                scored.append((total, a, b, x == y))
    gone, kept = set(), {}
    for total, a, b, equal in sorted(scored, key=lambda s: -s[0]):
        if a not in gone and b not in gone:
            kept[a, b] = (round(total, 6), equal and total >= auto)
            if kept[a, b][1]:
                gone.add(b)
    return kept, gone


def held(spark, entities, contexts, rejected):
    e = spark.createDataFrame([(i, n, t, None, None, True) for i, n, t in entities], ENTITY)
    ctx = spark.createDataFrame(list(contexts.items()), "id string, context string")
    no = spark.createDataFrame(list(rejected), "left_entity_id string, right_entity_id string")
    rows = resolve.scored_pairs(e, ctx, no).collect()
    found = {(x.left_entity_id, x.right_entity_id): (round(x.total_score, 6), x.identical and x.action == "auto_merge") for x in rows}
    kept, gone = loop(entities, contexts, rejected)
    assert len(rows) == len(found) and found == kept
    queue = resolve.kept_candidates(resolve.scored_pairs(e, ctx, no), resolve.auto_merges_with_rejected(e, no)).collect()
    assert {(x.left_entity_id, x.right_entity_id): x.is_stale for x in queue} == {k: bool(gone & set(k)) for k, v in kept.items() if not v[1]}
    return found


def test_a_variant_meets_what_the_first_of_its_class_misses(spark):
    names = [("e1", "perovskite film", "T"), ("e2", "perovskite-film", "T"), ("e3", "perovskite-films", "T")]
    found = held(spark, names, {i: "The film was annealed." for i, _, _ in names}, [])
    assert set(found) == {("e1", "e2"), ("e2", "e3")}
    # a rejection of the class's first takes off its own pair only
    found = held(spark, names + [("e4", "perovskite film", "T")], {i: "The film was annealed." for i in ("e1", "e2", "e3", "e4")}, [("e2", "e1"), ("e4", "e1")])
    assert set(found) == {("e2", "e3"), ("e2", "e4")}


def test_all_pairs(spark):
    r = random.Random(3)
    words = ["oxide", "zinc", "perovskite", "film", "films", "alloy"]
    told = ["The film was annealed at 300 K.", "A copper alloy melts slowly.", "Hardness rose after milling.", "The film was annealed at 310 K."]
    ids = [f"e{i:03}" for i in range(130)]
    named = [(i, r.choice([" ", "-", "_", " (", ""]).join(r.choices(words, k=2)), r.choice("TTTU")) for i in ids]
    named = [(i, n.upper() if r.random() < 0.1 else n, t) for i, n, t in named]
    contexts = {i: r.choice(told) for i in ids}
    kept, _ = loop(named, contexts, [])
    rejected = r.sample(sorted(kept), 40) + [tuple(r.sample(ids, 2)) for _ in range(10)]
    found = held(spark, named, contexts, rejected)
    assert len(found) > 50 and any(v[0] < 1 for v in found.values())
    assert set(held(spark, named, contexts, [])) == set(kept)


def test_blocks_meet_each_other(spark, monkeypatch):
    r = random.Random(4)
    named = [(f"e{i:02}", " ".join(r.choices(["zinc", "oxide", "film", "films", "alloys"], k=2)), r.choice("TTU")) for i in range(60)]
    vec = embed.sparse_vectors(spark.createDataFrame(named, "id string, text string, entity_type string"))
    whole = {(x.left_id, x.right_id): round(x.score, 9) for x in resolve.similar_pairs(vec, 0.6).collect()}
    monkeypatch.setattr(resolve, "BLOCK", 7)
    rows = resolve.similar_pairs(vec, 0.6).collect()
    assert len(rows) == len(whole) > 50 and {(x.left_id, x.right_id): round(x.score, 9) for x in rows} == whole
