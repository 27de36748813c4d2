"""Entity resolution: scored pairs of one type, automatic merges, decisions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.names import aliases_of, resolution_key_of
from graphloom.functions.numbers import AUTO_MERGE, CANDIDATE, CONTEXT_WEIGHT, NAME_WEIGHT, dot, similarity_class, total_score
from graphloom.operators.embed import DIMENSIONS, sparse_vectors
from graphloom.runtime import discard, materialise

CONTEXT_SENTENCES = 5
#: Vectors of one type that are multiplied with each other in one task, about.
BLOCK = 4096


def check_thresholds(auto: float, candidate: float) -> None:
    if not 0 <= candidate <= auto <= 1:
        raise ValueError("thresholds must satisfy 0 <= candidate <= auto <= 1")


def contexts(entities: DataFrame, mentions: DataFrame, sentences: DataFrame, most: int = CONTEXT_SENTENCES) -> DataFrame:
    """(id, context): up to five sentences an entity is mentioned in, in paper order, else its name."""
    m = mentions.where("canonical_entity_id is not null").select(F.col("canonical_entity_id").alias("id"), "sentence_id", F.col("id").alias("mention_id"))
    s = sentences.select(F.col("id").alias("sentence_id"), "document_id", "ordinal", "text")
    found = m.join(s, "sentence_id")
    at = F.row_number().over(W.partitionBy("id").orderBy("document_id", "ordinal", "mention_id"))
    top = found.withColumn("at", at).where(F.col("at") <= most)
    joined = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return entities.select("id", "preferred_name").join(joined, "id", "left").select("id", F.coalesce(F.nullif(text, F.lit("")), "preferred_name").alias("context"))


def pair_keys(pairs: DataFrame) -> DataFrame:
    """(a, b): unordered pair keys."""
    return pairs.select(F.least("left_entity_id", "right_entity_id").alias("a"), F.greatest("left_entity_id", "right_entity_id").alias("b")).distinct()


def unrejected(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs (left_entity_id, right_entity_id, ...) that no rejected row names in either order."""
    keyed = pairs.withColumn("a", F.least("left_entity_id", "right_entity_id")).withColumn("b", F.greatest("left_entity_id", "right_entity_id"))
    return keyed.join(pair_keys(rejected), ["a", "b"], "left_anti").drop("a", "b")


def packed(vectors: DataFrame) -> DataFrame:
    """(id, entity_type, w) with a vector's weights as a map; a name has few buckets."""
    return vectors.groupBy("id", "entity_type").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))


def _map_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(b, x["key"]), F.lit(0.0)))


def pair_scores(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, score) of the listed pairs."""
    w = packed(vectors)
    left = w.select(F.col("id").alias("left_id"), F.col("w").alias("x"))
    right = w.select(F.col("id").alias("right_id"), F.col("w").alias("y"))
    return pairs.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", _map_dot(F.col("x"), F.col("y")).alias("score"))


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, entity_type, score) of pairs of one type with a cosine of at least ``least``, exact.

    With 256 buckets most names of a large type share one, so the pairs aren't joined: each type is cut into
    blocks of about BLOCK vectors by hash, and each pair of blocks is multiplied whole; only pairs that reach
    ``least`` leave a task.
    """
    rows = vectors.groupBy("id", "entity_type").agg(F.collect_list("bucket").alias("b"), F.collect_list("weight").alias("w"))
    sizes = vectors.select("id", "entity_type").distinct().groupBy("entity_type").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(sizes, "entity_type").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("id", "entity_type", "b", "w", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def multiply(t: pa.Table) -> pa.Table:
        ids, block = np.array(t.column("id").to_pylist(), object), t.column("block").to_numpy()
        kind, lo, hi = t.column("entity_type")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        b = t.column("b").combine_chunks()
        dense = np.zeros((len(ids), DIMENSIONS))
        at = np.repeat(np.arange(len(ids)), np.asarray(b.value_lengths()))
        dense[at, np.asarray(b.flatten())] = np.asarray(t.column("w").combine_chunks().flatten())
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        left, right, score = [], [], []
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            s = dense[part] @ dense[y].T
            i, j = np.nonzero(s >= least)
            i, j, s = part[i], y[j], s[i, j]
            keep = (i < j) if lo == hi else np.ones(len(i), bool)
            left += list(ids[i[keep]])
            right += list(ids[j[keep]])
            score += s[keep].tolist()
        ends = [(p, q) if p < q else (q, p) for p, q in zip(left, right)]
        return pa.table({
            "left_id": pa.array([p for p, _ in ends], pa.string()), "right_id": pa.array([q for _, q in ends], pa.string()),
            "entity_type": pa.array([kind] * len(ends), pa.string()), "score": pa.array(score, pa.float64()),
        })

    return sent.groupBy("entity_type", "lo", "hi").applyInArrow(multiply, "left_id string, right_id string, entity_type string, score double")


def dense_pairs(vectors: DataFrame, by: str, least: float) -> DataFrame:
    """(left_id, right_id, score) of vectors (id, by, embedding) of one group with a cosine of at least ``least``, exact.

    Vectors are sorted into blocks by their place on the line between two far points; where the bound of
    the triangle says that no pair of two blocks can reach ``least``, they are never brought together, the
    others are multiplied whole. Vectors that are null, hold a null or have no length pair with nothing.
    """
    ok = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    e = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    rows = ok.select("id", F.col(by).alias("g"), F.transform(e, lambda x: x / norm).alias("u")).where("g is not null")
    pole = rows.groupBy("g").agg(F.min_by("u", "id").alias("pole"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = materialise(rows.join(pole, "g").withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("u"), F.col("pole")))))).select("g", "id", "u", "angle", "blocks"), "vectors")
    cuts = rows.groupBy("g").agg(F.percentile_approx("angle", F.array(*[F.lit(k / 256) for k in range(1, 256)]), 10000).alias("cuts"))
    level = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
    parts = F.greatest(F.ceil(F.col("blocks") / 256), F.lit(1))  # of one range of angles
    block = F.floor(level * F.least(F.col("blocks"), F.lit(256)) / 256) * parts + F.pmod(F.xxhash64("id"), parts)
    placed = rows.join(cuts, "g").withColumn("block", block).select("g", "id", "u", "angle", "block")
    ranges = placed.groupBy("g", "block").agg(F.min("angle").alias("near"), F.max("angle").alias("far"))
    a, b = ranges.select("g", F.col("block").alias("lo"), F.col("near").alias("n1"), F.col("far").alias("f1")), ranges.select("g", F.col("block").alias("hi"), F.col("near").alias("n2"), F.col("far").alias("f2"))
    reach = float(np.arccos(max(-1.0, min(1.0, least)))) + 1e-9
    pairs = a.join(b, "g").where("lo <= hi").where((F.col("n2") - F.col("f1") <= reach) & (F.col("n1") - F.col("f2") <= reach)).select("g", "lo", "hi")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    sent = placed.drop("angle").join(sides, ["g", "block"])

    def multiply(t: pa.Table) -> pa.Table:
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        u = t.column("u").to_pylist()
        width = min(map(len, u))
        u = np.array([x[:width] for x in u])
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        left, right, score = [], [], []
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            s = u[part] @ u[y].T
            i, j = np.nonzero(s >= least)
            keep = (ids[part[i]] < ids[y[j]]) if lo == hi else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            left.append(np.minimum(ids[part[i]], ids[y[j]]))
            right.append(np.maximum(ids[part[i]], ids[y[j]]))
            score.append(s[i, j])
        return pa.table({"left_id": pa.array(np.concatenate(left)), "right_id": pa.array(np.concatenate(right)), "score": pa.array(np.concatenate(score))})

    return sent.groupBy("g", "lo", "hi").applyInArrow(multiply, "left_id bigint, right_id bigint, score double")


def scored_pairs(
    entities: DataFrame, context: DataFrame, rejected: DataFrame | None = None, auto: float = AUTO_MERGE, candidate: float = CANDIDATE
) -> DataFrame:
    """(left_entity_id, right_entity_id, entity_type, name_score, context_score, total_score,
    same_name, identical, action).

    Every pair the loop over all pairs of active entities of one type keeps, taken best total first and then
    in id order: the total reaches ``candidate``, nobody rejected the pair, and neither end was merged away
    before its turn. Entities of equal type and name are merged first of all, so only survivors are compared
    with other names, one head for each name, and a rejection takes off its own pair alone. Where name keys
    are equal the total is 1 and the turn comes with the merges: a survivor also meets those whose own
    survivor comes later. As a context adds at most its weight, names with different keys need a name score
    of (candidate - 0.3) / 0.7 at least; contexts are compared for those only.
    """
    check_thresholds(auto, candidate)
    merges = auto_merges(entities) if rejected is None else auto_merges_with_rejected(entities, rejected)
    e = entities.where("active and id is not null and entity_type is not null and preferred_name is not null")
    e = e.select("id", "entity_type", "preferred_name").withColumn("name_key", resolution_key_of(F.col("preferred_name"))).join(merges, "id", "left")
    e = materialise(e, "named")
    live = e.where("survivor_id is null")
    heads = live.groupBy("entity_type", "preferred_name", "name_key").agg(F.min("id").alias("head_id"))
    names = sparse_vectors(heads.select(F.col("preferred_name").alias("text"), F.col("head_id").alias("id"), "entity_type"))
    floor = (candidate - CONTEXT_WEIGHT) / NAME_WEIGHT - 1e-9
    near = similar_pairs(names, max(floor, 0.05)).withColumnRenamed("score", "name_score")
    # a name has one survivor, and more only where pairs of that name were rejected
    ends = live.join(heads, ["entity_type", "preferred_name", "name_key"])
    for side in ("left", "right"):
        near = near.join(ends.select(F.col("head_id").alias(f"{side}_id"), F.col("id").alias(f"{side}_end"), F.col("name_key").alias(f"{side}_key")), f"{side}_id")
    near = near.where("left_key <> right_key").select(
        F.least("left_end", "right_end").alias("left_id"), F.greatest("left_end", "right_end").alias("right_id"), "entity_type", "name_score",
        F.lit(False).alias("same_name"), F.lit(False).alias("identical"),
    )
    first = live.select("entity_type", "name_key", F.col("id").alias("left_id"), F.col("preferred_name").alias("left_name"))
    same = e.withColumnRenamed("id", "right_id").join(first, ["entity_type", "name_key"])
    same = same.where("left_id < right_id and left_id <= coalesce(survivor_id, right_id)").select(
        "left_id", "right_id", "entity_type", F.lit(True).alias("same_name"), (F.col("left_name") == F.col("preferred_name")).alias("identical")
    )
    everyone = sparse_vectors(e.select(F.col("preferred_name").alias("text"), "id", "entity_type"))
    same = same.join(pair_scores(everyone, same.select("left_id", "right_id")).withColumnRenamed("score", "name_score"), ["left_id", "right_id"], "left")
    pairs = near.unionByName(same)
    if rejected is not None:
        pairs = unrejected(pairs.withColumnsRenamed({"left_id": "left_entity_id", "right_id": "right_entity_id"}), rejected).withColumnsRenamed(
            {"left_entity_id": "left_id", "right_entity_id": "right_id"}
        )
    pairs = materialise(pairs, "pairs")
    told = e.join(context, "id").select("id", "entity_type", F.col("context").alias("text"))
    contextual = pair_scores(sparse_vectors(told), pairs.select("left_id", "right_id")).withColumnRenamed("score", "context_score")
    scored = pairs.join(contextual, ["left_id", "right_id"], "left").select(
        F.col("left_id").alias("left_entity_id"),
        F.col("right_id").alias("right_entity_id"),
        "entity_type",
        F.coalesce("name_score", F.lit(0.0)).alias("name_score"),
        F.coalesce("context_score", F.lit(0.0)).alias("context_score"),
        "same_name",
        "identical",
    )
    scored = scored.withColumn("total_score", total_score(F.col("name_score"), F.col("context_score"), F.col("same_name")))
    return scored.where(F.col("total_score") >= candidate).withColumn("action", similarity_class(F.col("total_score"), auto, candidate))


def auto_merges(entities: DataFrame) -> DataFrame:
    """(id, survivor_id) of active entities folded into the first of equal type and name.

    Automatic merges ask for equal preferred names; equal names make the total 1, so without rejected
    pairs the greedy loop over pairs comes down to the first entity of each name.
    """
    first = F.min("id").over(W.partitionBy("entity_type", "preferred_name"))
    e = entities.where("active and preferred_name is not null and entity_type is not null and id is not null")
    return e.select("id", first.alias("survivor_id")).where("id <> survivor_id")


def auto_merges_with_rejected(entities: DataFrame, rejected: DataFrame) -> DataFrame:
    """The same where some pairs were rejected: a greedy pass in id order inside each group of equal names.

    The first of a name takes all that weren't rejected with it. Only what was is left to go on with, so
    what is walked grows with the rejections that name the first, not with the group.
    """
    e = entities.where("active and preferred_name is not null and entity_type is not null and id is not null")
    e = e.select("id", "entity_type", "preferred_name", F.min("id").over(W.partitionBy("entity_type", "preferred_name")).alias("survivor_id")).where("id <> survivor_id").distinct()
    no = pair_keys(rejected)
    first = no.select(F.col("a").alias("survivor_id"), F.col("b").alias("id"))
    plain = e.join(first, ["survivor_id", "id"], "left_anti").select("id", "survivor_id")
    left = e.join(first, ["survivor_id", "id"], "left_semi").select("id", "entity_type", "preferred_name")
    ends = [left.select(F.col("id").alias(c), "entity_type", "preferred_name") for c in ("a", "b")]
    among = no.join(ends[0], "a").join(ends[1], ["b", "entity_type", "preferred_name"])

    def walk(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        ids = sorted(set(rows.column("id").to_pylist()))
        banned = set(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()))
        gone: dict[str, str] = {}
        for i, a in enumerate(ids):
            if a in gone:
                continue
            for b in ids[i + 1 :]:
                if b not in gone and (a, b) not in banned:
                    gone[b] = a
        return pa.table({"id": pa.array(list(gone), pa.string()), "survivor_id": pa.array(list(gone.values()), pa.string())})

    keys = ["entity_type", "preferred_name"]
    among = among.select("a", "b", *[F.col(k).alias(f"_{k}") for k in keys])  # both sides of the cogroup come from one table
    return plain.unionByName(left.groupBy(*keys).cogroup(among.groupBy(*[f"_{k}" for k in keys])).applyInArrow(walk, "id string, survivor_id string"))


def final_survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor_id) of merges (id, survivor_id) followed to the end of their chains.

    Every round doubles how far a chain is followed. Of several survivors of an id the first counts;
    merges in a circle fail.
    """
    m = materialise(merges.where("id <> survivor_id").groupBy("id").agg(F.min("survivor_id").alias("survivor_id")), "merges")
    for n in range(m.count().bit_length() + 1):
        onward = m.select(F.col("id").alias("survivor_id"), F.col("survivor_id").alias("onward"))
        far = materialise(m.join(onward, "survivor_id", "left").select("id", F.coalesce("onward", "survivor_id").alias("survivor_id"), F.col("onward").isNotNull().alias("moved")), f"merges{n}")
        moved = not far.where("moved").isEmpty()
        if moved and not far.where("id = survivor_id").isEmpty():
            break
        discard(m)
        m = far.drop("moved")
        if not moved:
            return m
    raise ValueError("merges run in a circle")


def kept_candidates(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """Scored pairs left for people, in the order of the queue, each flagged stale where an end was merged away."""
    gone = merged.select("id").distinct()
    left = gone.select(F.col("id").alias("left_entity_id"), F.lit(True).alias("_l"))
    right = gone.select(F.col("id").alias("right_entity_id"), F.lit(True).alias("_r"))
    out = pairs.join(left, "left_entity_id", "left").join(right, "right_entity_id", "left")
    return out.where("not (identical and action = 'auto_merge')").withColumn("is_stale", F.coalesce("_l", "_r", F.lit(False))).drop("_l", "_r")


def run_summary(rows: DataFrame) -> DataFrame:
    """(auto_merged, candidates, pairs_scored) of a run's candidate rows."""
    return rows.agg(F.count_if(F.col("status") == "auto_merged").alias("auto_merged"), F.count_if(F.col("status") == "pending").alias("candidates"), F.count("*").alias("pairs_scored"))


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after merges (id, survivor_id[, preferred_name]): aliases united, merged ones inactive.

    A survivor's aliases gain the names and aliases of all folded into it, along chains of merges, and its
    own names, old and new, sorted by value; a given preferred name replaces its name.
    """
    m = final_survivors(merges)
    folded = (
        m.join(entities.select("id", "preferred_name", aliases_of(F.col("aliases_json")).alias("al")), "id")
        .groupBy("survivor_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat("al", F.array("preferred_name"))))).alias("more"))
    )
    out = entities.join(folded.withColumnRenamed("survivor_id", "id"), "id", "left")
    if "preferred_name" in merges.columns:
        renamed = merges.where("preferred_name is not null").groupBy(F.col("survivor_id").alias("id")).agg(F.max("preferred_name").alias("_new"))
        out = out.join(renamed, "id", "left")
    else:
        out = out.withColumn("_new", F.lit(None).cast("string"))
    out = out.join(m.select("id", F.lit(True).alias("_gone")), "id", "left").withColumn("_name", F.coalesce("_new", "preferred_name"))
    united = F.array_sort(F.array_distinct(F.array_compact(F.concat(aliases_of(F.col("aliases_json")), "more", F.array("preferred_name", "_name")))))
    return out.select(
        "id", F.col("_name").alias("preferred_name"), "entity_type", "description",
        F.when(F.col("more").isNotNull(), F.to_json(united)).otherwise(F.col("aliases_json")).alias("aliases_json"),
        (F.col("active") & F.col("_gone").isNull()).alias("active"),
    )


def repointed(mentions: DataFrame, merges: DataFrame) -> DataFrame:
    """Mentions of merged entities pointing to the survivors at the ends of their chains."""
    to = final_survivors(merges).select(F.col("id").alias("canonical_entity_id"), "survivor_id")
    return mentions.join(to, "canonical_entity_id", "left").withColumn("canonical_entity_id", F.coalesce("survivor_id", "canonical_entity_id")).select(*mentions.columns)


def decide(candidates: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates after decisions, merges) for decisions (id, decision[, preferred_name]).

    reject, defer and merge set the status; a merge of different names must choose one of them, and folds
    the right entity into the left. Pending candidates that touch a merged-away entity are superseded,
    deferred ones stay. Wrong decisions fail the job that reads the result.
    """
    e = entities.select("id", "preferred_name", "active")
    d = decisions.select(F.col("id"), F.col("decision"), *([F.col("preferred_name").alias("chosen")] if "preferred_name" in decisions.columns else [F.lit(None).cast("string").alias("chosen")]))
    c = candidates.join(d, "id", "left")
    for side in ("left", "right"):
        c = c.join(e.select(F.col("id").alias(f"{side}_entity_id"), F.col("preferred_name").alias(f"{side}_name"), F.col("active").alias(f"{side}_active")), f"{side}_entity_id", "left")
    bad = (
        F.when(~F.col("decision").isin("reject", "defer", "merge"), "unknown decision")
        .when((F.col("decision") == "merge") & ~F.coalesce(F.col("left_active") & F.col("right_active"), F.lit(False)), "an entity of the pair is not active")
        .when((F.col("decision") == "merge") & (F.col("left_name") != F.col("right_name")) & ~F.coalesce(F.col("chosen").isin(F.col("left_name"), F.col("right_name")), F.lit(False)), "choose one of the two names")
    )
    status = (
        F.when(F.col("decision").isNull(), F.col("status")).when(bad.isNotNull(), F.raise_error(bad))
        .when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "defer", "deferred").otherwise("merged")
    )
    c = c.withColumn("status", status)
    merges = c.where("decision = 'merge' and status = 'merged'").select(F.col("right_entity_id").alias("id"), F.col("left_entity_id").alias("survivor_id"), F.col("chosen").alias("preferred_name"))
    gone = merges.select(F.col("id").alias("x")).distinct()
    touched = candidates.join(gone, F.col("left_entity_id") == F.col("x"), "left_semi").select("id").unionByName(
        candidates.join(gone, F.col("right_entity_id") == F.col("x"), "left_semi").select("id")
    ).distinct().withColumn("_hit", F.lit(True))
    after = c.join(touched, "id", "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("_hit"), "superseded").otherwise(F.col("status")))
    return after.select(*candidates.columns), merges


def queue(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Open candidates with both entities, best total first; those with a missing side are left out."""
    e = entities.select("id", "preferred_name", "entity_type", aliases_of(F.col("aliases_json")).alias("aliases"))
    out = candidates.where(F.col("status").isin("pending", "deferred"))
    for side in ("left", "right"):
        out = out.join(e.select(*[F.col(c).alias(f"{side}_{'entity_id' if c == 'id' else c}") for c in e.columns]), f"{side}_entity_id")
    return out.orderBy(F.desc("total_score"), "id")


