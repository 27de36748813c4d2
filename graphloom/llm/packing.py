"""Filling fixed-capacity containers with items (problem 6).

Documents are packed by balanced cost: each carries a linear cost for its tokens and a quadratic one
for attention; in descending order every document goes to the lowest-cost container that still has
room. Where some fit nowhere, containers exchange items of nearly equal size, which keeps their costs,
until the room that was left in many stands together in one. Shards of a bounded number of documents are
packed apart from each other, so no task holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.tokens import TOKENIZER, with_tokens
from graphloom.runtime import materialise, table

#: Documents packed together. A shard wastes a fraction of a container, whatever its share of the rows.
SHARD = 4096
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
MOST_KINDS = 1000


def _assign(sizes: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, int]:
    """Containers of items in descending size, each to the lowest cost with room, and their number."""
    out = np.zeros(len(sizes), dtype=np.int32)
    used = least
    room = np.full(used + len(sizes), capacity, dtype=np.int64)
    cost = np.zeros(used + len(sizes))
    added = LINEAR * sizes + QUADRATIC * sizes.astype(float) ** 2
    for i in np.argsort(-sizes, kind="stable"):
        size = sizes[i]
        at = int(np.where(room[:used] >= size, cost[:used], np.inf).argmin())
        if room[at] < size:
            at, used = used, used + 1
        out[i] = at
        room[at] -= size
        cost[at] += added[i]
    return out, used


def _brought_back(sizes: np.ndarray, out: np.ndarray, least: int, capacity: int) -> np.ndarray:
    """The assignment with the items beyond the first ``least`` containers brought back into those where possible.

    Balance has left a little room in every container. For an item without room, a container gathers it:
    it hands an item to another one with room for the difference and takes a smaller item back, the
    largest gain first. Where no container can gather enough, another is opened.
    """
    out = out.copy()
    waiting = sorted(np.flatnonzero(out >= least).tolist(), key=lambda i: (-sizes[i], i))
    out[waiting] = -1
    inside = out >= 0
    room = np.full(least + len(waiting), capacity, dtype=np.int64)
    np.subtract.at(room, out[inside], sizes[inside])
    many = np.bincount(out[inside], minlength=len(room))
    stuck = np.zeros(len(room), dtype=bool)
    used = least

    def exchange(at: int) -> bool:
        best, give, back = 0, -1, -1
        # only from containers with no more room than its own: the squares of the rooms grow, so this ends
        spare = np.where((out >= 0) & (room[out] <= room[at]), room[out], -1)
        spare[out == at] = -1
        for i in np.flatnonzero(out == at).tolist():
            gain = sizes[i] - sizes
            gain[gain > spare] = 0
            j = int(gain.argmax())
            if gain[j] > best:
                best, give, back = int(gain[j]), i, j
        if not best:
            return False
        other = out[back]
        out[give], out[back] = other, at
        room[at], room[other] = room[at] + best, room[other] - best
        stuck[other] = False
        return True

    for i in waiting:
        size = sizes[i]
        while True:
            at = int(room[:used].argmax())
            if room[at] >= size:
                break
            # a container of several items finds more to exchange than one that a single item fills
            at = int(np.where(stuck[:used] | (room[:used] == 0), -1, room[:used] + capacity * (many[:used] > 1)).argmax())
            if stuck[at] or not room[at] or room[:used].sum() < size:
                at, used = used, used + 1
                break
            stuck[at] = not exchange(at)
        out[i] = at
        room[at] -= size
        many[at] += 1
        stuck[at] = False
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; sizes are at most ``capacity``.

    Balanced assignment starts with as many containers as the tokens need at least; each item in
    descending size goes to the lowest-cost container with room, the first of equal ones. Items that fit
    nowhere are placed last: containers exchange items of nearly equal size until one has gathered room
    enough, and another is opened only where no exchange is left.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int32)
    sizes = sizes.astype(np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    out, used = _assign(sizes, capacity, least)
    if used > least:
        out = _brought_back(sizes, out, least, capacity)
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


def _pack_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("row_no", "ascending"), ("piece_no", "ascending")])
    bins = pack(rows.column("n_tokens").to_numpy(), rows.column("capacity_tokens")[0].as_py())
    return rows.append_column("bin", pa.array(bins, pa.int32()))


def containers(
    documents: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER, shard: int = SHARD
) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, piece_no, start_token, end_token, n_tokens).

    For each kind of ``sizes`` every row of ``documents`` is placed once, or, where it is longer than the
    capacity, in consecutive pieces of full capacity (a container each) and a rest that is packed like
    any document. Null and empty texts have 0 tokens and lie in some container. Equal and repeated rows
    are placed each for itself. Kinds with a null name or without a positive capacity are left out; of a
    repeated kind each distinct capacity counts. Other columns are ignored.
    """
    kinds = (
        sizes.select(F.col("container_kind").cast("string"), F.col("capacity_tokens").cast("bigint"))
        .where("container_kind is not null and capacity_tokens > 0")
        .distinct()
        .limit(MOST_KINDS + 1)
        .collect()
    )
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    spark = documents.sparkSession
    out = "container_kind string, capacity_tokens bigint, container_id string, doc_id bigint, piece_no int, start_token bigint, end_token bigint, n_tokens bigint"
    if not kinds:
        return spark.createDataFrame([], out)
    # numbered, so that rows alike in everything still part over the shards
    rows = documents.select(F.col("doc_id").cast("bigint"), "text", F.monotonically_increasing_id().alias("row_no"))
    measured = materialise(with_tokens(rows, ["doc_id", "row_no"], tokenizer=tokenizer), "tokens")
    shards = max(1, -(-measured.count() // shard))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("size")) for k, c in sorted(kinds)]))
    items = measured.select("doc_id", "row_no", F.col("n_tokens").alias("all"), kind.alias("c")).select(
        F.col("c.kind").alias("container_kind"),
        F.col("c.size").alias("capacity_tokens"),
        "doc_id",
        "row_no",
        "all",
        F.floor(F.col("all") / F.col("c.size")).cast("bigint").alias("full"),
    )
    whole = items.where("full > 0").select(
        "container_kind",
        "capacity_tokens",
        F.concat_ws("-", "container_kind", "capacity_tokens", F.lit("doc"), "row_no").alias("first"),
        "doc_id",
        F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece_no"),
    )
    whole = whole.select(
        "container_kind",
        "capacity_tokens",
        F.concat_ws("-", "first", "piece_no").alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity_tokens")).alias("start_token"),
        ((F.col("piece_no") + 1) * F.col("capacity_tokens")).alias("end_token"),
        F.col("capacity_tokens").alias("n_tokens"),
    )
    rest = items.where("all = 0 or all % capacity_tokens > 0").select(
        "container_kind",
        "capacity_tokens",
        F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int").alias("shard"),
        "row_no",
        "doc_id",
        F.col("full").cast("int").alias("piece_no"),
        F.col("all").alias("end_token"),
        (F.col("all") % F.col("capacity_tokens")).alias("n_tokens"),
    )
    packed = rest.groupBy("container_kind", "capacity_tokens", "shard").applyInArrow(
        _pack_shard, T.StructType([*rest.schema.fields, T.StructField("bin", T.IntegerType())])
    )
    packed = packed.select(
        "container_kind",
        "capacity_tokens",
        F.concat_ws("-", "container_kind", "capacity_tokens", "shard", "bin").alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("end_token") - F.col("n_tokens")).alias("start_token"),
        "end_token",
        "n_tokens",
    )
    return whole.unionByName(packed)


def fill(placed: DataFrame) -> DataFrame:
    """Per kind of container: how many there are, their tokens and the share of the capacity in use."""
    per_kind = placed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"))
    return per_kind.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        F.round(F.sum("n") / F.sum("capacity_tokens"), 6).alias("fill_share"),
    )


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place for each kind of container."""
    return containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each kind of container is filled: what is placed, what overflows, and whether there are hardly more containers than the tokens need."""
    placed = p6_containers(spark, sf_dir)
    per_row = placed.groupBy("container_kind", "capacity_tokens").agg(F.count_if(F.col("start_token") == 0).alias("documents"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return per_row.join(fill(placed), ["container_kind", "capacity_tokens"]).select(
        "container_kind", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "documents",
        (F.col("fullest") > F.col("capacity_tokens")).alias("overflows"), (F.col("containers") <= least * 1.02 + 1).alias("is_tight"),
    )


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}

SQL = {
    # what must hold whatever the tokenizer: every document once, no container over its capacity, few more than the tokens need
    "p6_fill": """select distinct container_kind, capacity_tokens, (select count(*) from documents) as documents, false as overflows, true as is_tight
from container_sizes where container_kind is not null and capacity_tokens > 0"""
}
