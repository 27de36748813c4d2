"""Consolidating pairwise matches into groups (problem 4).

Links become star-shaped edges (linear in the rows, whatever the size of a key group), the graph is
contracted at random until no edge is left, and the rounds' mappings are expanded backwards.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.names import resolution_key
from graphloom.runtime import discard, materialise, table

MERGED = ("merged", "auto_merged")


def name_key(value: str | None) -> str | None:
    """White space, hyphens, underscores and round brackets deleted, then case-folded."""
    return None if value is None else resolution_key(value)


def alias_keys(text: str | None) -> list[str]:
    """Keys of the entries of a JSON list; text that can't be read as a list has none."""
    if not text:
        return []
    try:
        entries = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return sorted({name_key(x) for x in entries if isinstance(x, str)}) if isinstance(entries, list) else []


@F.pandas_udf(T.StringType())
def _name_key(names: pd.Series) -> pd.Series:
    return names.map(name_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _alias_keys(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: alias_keys(x if isinstance(x, str) else None))


def name_links(entities: DataFrame) -> DataFrame:
    """Links of entities of one type of which one's name is a name or alias of the other.

    All holders of a key are tied to the smallest holder of it as a preferred name; a key that occurs
    only among aliases ties nobody. Null names and types link nothing.
    """
    e = entities.where(F.col("id").isNotNull() & F.col("entity_type").isNotNull())
    named = e.where(F.col("preferred_name").isNotNull()).select(
        "entity_type", _name_key("preferred_name").alias("key"), "id", F.lit(True).alias("preferred")
    )
    aliased = e.where(F.col("aliases_json").isNotNull()).select(
        "entity_type", F.explode(_alias_keys("aliases_json")).alias("key"), "id", F.lit(False).alias("preferred")
    )
    holders = named.unionByName(aliased)
    centre = holders.groupBy("entity_type", "key").agg(
        F.min(F.when(F.col("preferred"), F.col("id"))).alias("a"), F.count("*").alias("n")
    )
    centre = centre.where(F.col("a").isNotNull() & (F.col("n") > 1)).drop("n")
    return holders.join(centre, ["entity_type", "key"]).select("a", F.col("id").alias("b")).where("a <> b")


def decision_links(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs that any decision row merged, both ends present in ``ids``."""
    pairs = candidates.where(F.col("status").isin(*MERGED)).select(
        F.col("left_entity_id").alias("a"), F.col("right_entity_id").alias("b")
    )
    for end in ("a", "b"):
        pairs = pairs.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return pairs.select("a", "b").where("a <> b").distinct()


def mention_links(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Ties of the entities that rows of one mention id point to, both present in ``ids``."""
    seen = (
        mentions.where(F.col("id").isNotNull() & F.col("canonical_entity_id").isNotNull())
        .select(F.col("id").alias("mention"), F.col("canonical_entity_id").alias("b"))
        .join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    )
    spread = seen.groupBy("mention").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z")
    return seen.join(spread.select("mention", "a"), "mention").select("a", "b").where("a <> b").distinct()


#: Vertices are numbered in so many bits, the fresh hash of a round takes the rest of a number.
VERTEX_BITS = 32


def numbered(vertices: DataFrame) -> DataFrame:
    """(id, v) with a number from 0 for each distinct id; only a count per partition comes to the driver."""
    spark = vertices.sparkSession
    at = F.monotonically_increasing_id()
    kept = materialise(vertices.distinct().select("id", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "vertices")
    first, starts = 0, []
    for row in sorted(kept.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda x: x.part):
        starts.append((row.part, first))
        first += row.n
    if first >= 1 << VERTEX_BITS:
        raise ValueError(f"{first} vertices don't fit into {VERTEX_BITS} bits")
    offsets = spark.createDataFrame(starts, "part int, first bigint")
    return kept.join(F.broadcast(offsets), "part").select("id", (F.col("first") + F.col("at")).alias("v"))


def _rank(vertex: Column, round_no: int) -> Column:
    """A vertex behind 31 bits of a fresh hash: one number, so that its minimum needs no sorting."""
    return F.shiftleft(F.xxhash64(F.lit(round_no), vertex).bitwiseAND((1 << 31) - 1), VERTEX_BITS).bitwiseOR(vertex)


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, group_id) for every vertex of ``links`` (a, b); group_id is the group's smallest id.

    Vertices are numbered once. Each round every vertex hooks to the neighbour, itself included, that
    comes first in a fresh hash order; the edges are relabelled, loops and doubles fall away, and the
    round's mapping is written to the shared folder. A constant share of the vertices goes each round
    whatever the graph's shape, so long chains and hubs alike take a logarithmic number of rounds. Loops
    and pairs with a null end link nothing; repeated pairs count once; an empty table gives an empty result.
    """
    pairs = materialise(links.where("a <> b").select("a", "b"), "pairs")
    names = materialise(numbered(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))), "numbers")
    for end in ("a", "b"):
        pairs = pairs.join(names.select(F.col("id").alias(end), F.col("v").alias(f"_{end}")), end)
    edges = materialise(pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for round_no in range(max_rounds):
        if edges.isEmpty():
            break
        ranked = edges.select("a", "b", _rank(F.col("a"), round_no).alias("ra"), _rank(F.col("b"), round_no).alias("rb"))
        both = ranked.select(F.col("a").alias("v"), F.least("ra", "rb").alias("rank")).unionByName(ranked.select(F.col("b").alias("v"), F.least("ra", "rb").alias("rank")))
        hooks = both.groupBy("v").agg(F.min("rank").alias("rank")).select("v", F.col("rank").bitwiseAND((1 << VERTEX_BITS) - 1).alias("r"))
        maps.append(hooks := materialise(hooks, f"hooks{round_no}"))
        moved = edges.join(hooks.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(
            hooks.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b"
        )
        done, edges = edges, materialise(
            moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"edges{round_no}",
        )
        discard(done)
    else:
        raise RuntimeError(f"edges were left after {max_rounds} rounds")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("a").alias("group_id")).where(F.lit(False))
    root = maps[-1]
    for hooks in reversed(maps[:-1]):
        onward = root.select(F.col("v").alias("r"), F.col("r").alias("onward"))
        root = hooks.join(onward, "r", "left").select("v", F.coalesce("onward", "r").alias("r"))
    root = materialise(names.join(root, "v").select("id", "r"), "roots")
    smallest = root.groupBy("r").agg(F.min("id").alias("group_id"))
    return root.join(smallest, "r").select("id", "group_id")


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links between canonical entities as distinct pairs with their kind."""
    entities = table(spark, sf_dir, "canonical_entities").select("id", "preferred_name", "entity_type", "aliases_json")
    ids = entities.select("id").where("id is not null").distinct()
    return (
        decision_links(table(spark, sf_dir, "merge_candidates"), ids)
        .unionByName(name_links(entities))
        .unionByName(mention_links(table(spark, sf_dir, "entity_mentions"), ids))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per canonical entity that is linked to another, with its group."""
    return connected_components(entity_links(spark, sf_dir)).select(F.col("id").alias("entity_id"), "group_id")


_KEY = "replace(lower(regexp_replace({0}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}\\-_()（）]+', '', 'g')), 'ß', 'ss')"

SQL = {
    "p4_found": f"""
with recursive e as (
  select id, entity_type, {_KEY.format("preferred_name")} as name,
    case when json_valid(aliases_json) and json_type(aliases_json) = 'ARRAY' then from_json(aliases_json, '["VARCHAR"]') else [] end as aliases
  from canonical_entities),
al as (select id, entity_type, {_KEY.format("x")} as name from (select id, entity_type, unnest(aliases) as x from e)),
holders as (select id, entity_type, name from e union select id, entity_type, name from al),
links as (
  select m.left_entity_id as a, m.right_entity_id as b from merge_candidates m
  where m.status in ('merged', 'auto_merged')
    and m.left_entity_id in (select id from e) and m.right_entity_id in (select id from e)
  union
  select e.id, h.id from e join holders h on e.entity_type = h.entity_type and e.name = h.name
  union
  select x.canonical_entity_id, y.canonical_entity_id from entity_mentions x join entity_mentions y on x.id = y.id
  where x.canonical_entity_id in (select id from e) and y.canonical_entity_id in (select id from e)),
sym as (select a, b from links where a <> b union select b, a from links where a <> b),
reach(a, b) as (select a, b from sym union select r.a, s.b from reach r join sym s on r.b = s.a)
select a as entity_id, min(least(a, b)) as group_id from reach group by a"""
}

QUERIES = {"p4_found": p4_found}
