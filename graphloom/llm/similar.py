"""Most similar vectors for every vector (problem 2).

The index is a set of leaves, each a centroid with a bounded expected number of vectors. Every vector
lives in the leaf it is nearest to and visits the leaves that are almost as near. Inside a leaf the
members are held as randomly rotated one-bit codes; inner products are estimated from the packed bits
and two correction scalars; a member is reranked with a real inner product where the error bound lets it
reach both the least similarity and the k-th best already sure. The leaves' centroids come from a sample
of bounded size; where one stands for more vectors than a leaf holds, its task fits leaves of a second
level over them, and so on. Nothing is compared across all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import table

DIM = 64
K = 5
LEAST = 0.80
#: Rows the centroids are fitted on, at most about so many; every row is indexed all the same.
SAMPLE = 32768
#: Expected vectors of a leaf, and how many times as many a task searches without another level.
LEAF, SLACK = 2048, 4
#: A vector also visits all leaves whose centroid is at most so many radians farther than the nearest.
MARGIN = 0.11
#: Bits a query's coordinate is quantised to, and the width of the error bound in deviations.
QUERY_BITS = 4
BOUND = 2.2
SEED = 20
_ROUNDED = 1_000_000


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, embedding, h): rows with an id and ``dim`` finite values, not all zero; h is a hash of the values."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint"), e.cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(e) == dim) & fine & F.exists(e, lambda x: x != 0))
    # a zero has two bit patterns
    return rows.withColumn("h", F.xxhash64(F.transform(e, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("float"))))


def fit_leaves(sample: np.ndarray, total: int, leaf: int = LEAF, seed: int = SEED) -> np.ndarray:
    """Unit centroids from two-means splits of a sample until each part stands for ``leaf`` of ``total`` rows.

    Splitting by count keeps a dense region from ending in one leaf: it is cut as often as its share asks.
    """
    if not len(sample):
        return np.zeros((1, DIM), dtype=np.float32)
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    most = max(4, int(leaf * len(unit) / max(total, 1)))  # so at most a quarter as many centroids as samples
    parts, open_parts = [], [np.arange(len(unit))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= most:
            parts.append(part)
            continue
        x = unit[part]
        c = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(8):
            left = x @ (c[0] - c[1]) > 0
            if left.all() or not left.any():
                left = np.arange(len(x)) % 2 == 0
            c = np.stack([x[left].mean(0), x[~left].mean(0)])
        if min(left.sum(), (~left).sum()) * 20 < len(x):  # too lopsided to make headway: cut at the median
            d = x @ (c[0] - c[1])
            left = np.argsort(np.argsort(d, kind="stable"), kind="stable") >= len(x) // 2
        open_parts += [part[left], part[~left]]
    c = np.stack([unit[p].mean(0) for p in parts])
    for _ in range(4):
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9
        at = np.concatenate([(unit[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(unit), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, unit)
        counts = np.bincount(at, minlength=len(c))
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return (c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def _smallest(ids: np.ndarray, groups: np.ndarray, n_groups: int, k: int) -> list[np.ndarray]:
    """The k smallest distinct ids of each group."""
    order = np.lexsort((ids, groups))
    ids, groups = ids[order], groups[order]
    cuts = np.searchsorted(groups, np.arange(n_groups + 1))
    return [np.unique(ids[a:b])[:k] if b - a > 1 else ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_ROUTED = pa.schema([("leaf", pa.int32()), ("home", pa.bool_()), ("h", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])


def visits(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether at home) of unit vectors and the centroids they go to: the nearest and all within the margin."""
    rows, leaves, homes = [], [], []
    step = max(64, 4_000_000 // len(c))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ c.T
        first = near.argmax(1)
        best = np.take_along_axis(near, first[:, None], 1)
        least = np.cos(np.minimum(np.arccos(np.clip(best, -1, 1)) + margin, np.pi))
        goes = near >= least
        goes[np.arange(len(near)), first] = True
        row, leaf = np.nonzero(goes)
        rows.append(row + at)
        leaves.append(leaf)
        homes.append(leaf == first[row])
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def _route(centroids, k: int, margin: float):
    """Rows of (vec_id, embedding, h) to their leaves; copies within a batch travel once, with k + 1 ids.

    A home row carries single precision, a visiting row half precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            h, first, group = np.unique(batch.column(2).to_numpy(), return_index=True, return_inverse=True)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)[first].astype(np.float64)
            x = (x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)).astype(np.float32)
            id_lists = _smallest(ids, group, len(h), k + 1)
            row, leaf, home = visits(x, centroids.value, margin)
            full, half = x.tobytes(), x.astype(np.float16).tobytes()
            v = [full[r * DIM * 4 : (r + 1) * DIM * 4] if at_home else half[r * DIM * 2 : (r + 1) * DIM * 2] for r, at_home in zip(row.tolist(), home.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(leaf.astype(np.int32)),
                    pa.array(home),
                    pa.array(h[row]),
                    pa.array([id_lists[r] for r in row.tolist()], pa.list_(pa.int64())),
                    pa.array(v, pa.binary()),
                ],
                schema=_ROUTED,
            )

    return run


def rotation(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their norms, and their inner products with their own codes."""
    turned = residual @ turn
    norm = np.linalg.norm(turned, axis=1)
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    own = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.maximum(norm, 1e-12)
    return bits, norm, np.maximum(own, 1e-6)


class Leaf:
    """The codes of one leaf's members, and the estimate of their inner products with queries."""

    def __init__(self, members: np.ndarray, centroid: np.ndarray, turn: np.ndarray):
        self.members, self.centroid, self.turn = members, centroid, turn
        self.bits, self.norm, self.own = encode(members - centroid, turn)
        self.ones = np.bitwise_count(self.bits).astype(np.float32)
        self.along = members @ centroid - centroid @ centroid
        dim = members.shape[1]
        self.loose = (self.norm * np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own * BOUND / np.sqrt(dim - 1)).astype(np.float32)

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x members) and their error bounds."""
        dim = queries.shape[1]
        turned = (queries - self.centroid) @ self.turn
        size = np.linalg.norm(turned, axis=1)
        turned /= np.maximum(size, 1e-12)[:, None]
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        total = np.zeros((len(queries), len(self.bits)), dtype=np.uint16)
        for b in range(QUERY_BITS):
            plane = np.packbits((level >> b) & 1, axis=1, bitorder="little").view(np.uint64)
            total += np.bitwise_count(plane & self.bits[None, :]).astype(np.uint16) << b
        root = np.float32(np.sqrt(dim))
        code = total * (2 * step / root).astype(np.float32)[:, None]
        code += (2 * low / root).astype(np.float32)[:, None] * self.ones[None, :]
        code -= (step / root * level.sum(1, dtype=np.int64) + root * low).astype(np.float32)[:, None]
        code *= (self.norm / self.own).astype(np.float32)[None, :]
        code *= size.astype(np.float32)[:, None]
        code += self.along[None, :]
        code += (queries @ self.centroid)[:, None]
        return code, size.astype(np.float32)[:, None] * self.loose[None, :]

    def near(self, queries: np.ndarray, least: float, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, member, inner product) of pairs that reach ``least``, and how many products were taken.

        A pair is reranked where the bound allows it to reach ``least`` and to be among the query's k
        best: at least the k-th largest of the query's lower bounds, or the member's own ``floor``.
        """
        code, bound = self.estimate(queries)
        code += bound
        q, m = np.nonzero(code >= least)
        high = code[q, m]
        many = np.bincount(q, minlength=len(queries))
        if (many > k).any():
            low = high - 2 * bound[q, m]
            sure = np.full(len(queries), -np.inf, dtype=np.float32)
            best = _top(q, low, m, k)
            full = np.flatnonzero(many >= k)
            owner = q[best]
            last = np.searchsorted(owner, full, side="right") - 1  # the k-th of each query
            sure[full] = low[best[last]]
            keep = high >= sure[q]
            if floor is not None:
                keep |= high >= floor[m]
            q, m = q[keep], m[keep]
        value = np.empty(len(q))
        for at in range(0, len(q), 65536):
            part = slice(at, at + 65536)
            value[part] = np.einsum("ij,ij->i", queries[q[part]].astype(np.float64), self.members[m[part]].astype(np.float64))
        keep = value >= least - 1e-9
        return q[keep], m[keep], value[keep], len(q)


def _top(owner: np.ndarray, value: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best: larger value first, then smaller id."""
    order = np.lexsort((other, -value, owner))
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return order[rank < k]


_FOUND = pa.schema([("h", pa.int64()), ("other", pa.int64()), ("sim", pa.int32())])
_BLOCK = 256


class Cell:
    """All rows that came to one centroid: distinct vectors in hash order, whether at home, and their ids."""

    def __init__(self, x: np.ndarray, at_home: np.ndarray, ids: list[np.ndarray], k: int, least: float, margin: float, turn: np.ndarray):
        self.x, self.at_home, self.k, self.least, self.margin, self.turn = x, at_home, k, least, margin, turn
        self.many = np.array([len(i) for i in ids], dtype=np.int64)
        self.flat, self.start = np.concatenate(ids), np.concatenate([[0], np.cumsum(self.many)])
        self.leaves = 0

    def listed(self, owner: np.ndarray, near: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        """Near vectors as their ids, the k + 1 best of each owner."""
        n = self.many[near]
        place = np.repeat(self.start[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, value, other = np.repeat(owner, n), np.repeat(value, n), self.flat[place]
        best = _top(owner, value, other, self.k + 1)
        return owner[best], value[best], other[best]

    def found(self, centroid: np.ndarray) -> tuple[np.ndarray, ...]:
        """(owner, similarity, other id): the k + 1 best of every row within the cell."""
        own = np.flatnonzero(self.at_home & (self.many > 1))
        out = [self.listed(own, own, np.full(len(own), _ROUNDED, dtype=np.int64))]
        out += self._searched(np.flatnonzero(self.at_home), np.flatnonzero(~self.at_home), centroid)
        owner, value, other = (np.concatenate(c) for c in zip(*out))
        best = _top(owner, value, other, self.k + 1)
        return owner[best], value[best], other[best]

    def _searched(self, members: np.ndarray, guests: np.ndarray, centroid: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        if not len(members):
            return []
        if len(members) > SLACK * LEAF:
            step = -(-len(members) // SAMPLE)
            c = fit_leaves(self.x[members[::step]], len(members), LEAF)
            rows = np.concatenate([members, guests])
            row, leaf, nearest_one = visits(self.x[rows], c, self.margin)
            at_home = nearest_one & (row < len(members))
            order = np.argsort(leaf, kind="stable")
            row, leaf, at_home = row[order], leaf[order], at_home[order]
            cuts = np.searchsorted(leaf, np.arange(len(c) + 1))
            products = sum(int(at_home[a:b].sum()) * int(b - a) for a, b in zip(cuts[:-1], cuts[1:]))
            if 2 * products < len(members) * len(rows):  # vectors of one direction can't be parted
                out = []
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part, own = rows[row[a:b]], at_home[a:b]
                    out += self._searched(part[own], part[~own], c[i])
                return out
        self.leaves += 1
        leaf, out = Leaf(self.x[members], centroid, self.turn), []
        floor = np.full(len(members), self.least, dtype=np.float32)
        for queries in (members, guests):
            for a in range(0, len(queries), _BLOCK):
                asked = queries[a : a + _BLOCK]
                q, m, value, _ = leaf.near(self.x[asked], self.least, self.k + 1, floor if queries is guests else None)
                value = np.rint(value * _ROUNDED).astype(np.int64)
                apart = asked[q] != members[m]
                q, m, value = asked[q[apart]], m[apart], value[apart]
                out.append(self.listed(q, members[m], value))
                if queries is guests:
                    out.append(self.listed(members[m], q, value))
                elif len(q):
                    # what a member's own search made sure of bounds what guests may still bring it
                    n = np.bincount(np.searchsorted(asked, q), minlength=len(asked))
                    best = _top(q, value, m, self.k + 1)
                    full = np.flatnonzero(n > self.k)
                    last = np.searchsorted(q[best], asked[full], side="right") - 1
                    floor[a + full] = value[best[last]] / _ROUNDED - 1e-5
        return out


def _search(centroids, k: int, least: float, margin: float):
    turn = rotation()

    def run(rows: pa.Table) -> pa.Table:
        home = rows.column("home").to_numpy()
        h, group = np.unique(rows.column("h").to_numpy(), return_inverse=True)
        lists = rows.column("ids").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        ids = _smallest(lists.flatten().to_numpy(), np.repeat(group, lengths), len(h), k + 1)
        v = rows.column("v").to_pylist()
        x = np.zeros((len(h), DIM), dtype=np.float32)
        at_home = np.zeros(len(h), dtype=bool)
        for i, (g, own) in enumerate(zip(group.tolist(), home.tolist())):
            x[g] = np.frombuffer(v[i], dtype=np.float32 if own else np.float16)
            at_home[g] = own
        if not at_home.any():
            return _FOUND.empty_table()
        cell = Cell(x, at_home, ids, k, least, margin, turn)
        owner, value, other = cell.found(centroids.value[rows.column("leaf")[0].as_py()])
        return pa.table([pa.array(h[owner]), pa.array(other), pa.array(value.astype(np.int32))], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, k: int = K, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """(vec_id, other, similarity, rank): up to ``k`` most similar vectors of every usable vector.

    Cosine similarities of at least ``least``, rounded to 6 decimals; equal ones by smaller id. Vectors
    that are null, too short or long, all zero or not finite take no part. Equal vectors are compared as
    one and each lists its copies; repeated rows of an id count once. Pairs are found by
    either side's visit, so a pair is missed only if neither vector visits the other's leaf; tests hold
    the recall against brute force. Other columns of ``vectors`` are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(max(total, 1))) < SAMPLE)
    drawn = picked.groupBy("h").agg(F.min("embedding").alias("embedding")).toArrow()
    sample = np.array(drawn.column("embedding").to_pylist(), dtype=np.float32).reshape(-1, DIM)
    sample = sample[np.argsort(drawn.column("h").to_numpy())]  # whatever order the rows arrived in
    fitted = fit_leaves(sample, total)
    centroids = spark.sparkContext.broadcast(fitted)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(fitted) // 2)  # a few leaves a task at any size
    routed = rows.mapInArrow(
        _route(centroids, k, margin), "leaf int, home boolean, h bigint, ids array<bigint>, v binary"
    )
    found = routed.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(_search(centroids, k, least, margin), "h bigint, other bigint, sim int")
    lists = (
        found.repartition("h")
        .groupBy("h", "other")
        .agg(F.max("sim").alias("sim"))
        .groupBy("h")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k + 1).alias("near"))
    )
    mine = rows.select("vec_id", "h").distinct().join(lists, "h")
    kept = F.slice(F.filter("near", lambda n: n["other"] != F.col("vec_id")), 1, k)
    return mine.select("vec_id", F.posexplode(kept).alias("at", "n")).select(
        "vec_id",
        F.col("n.other").alias("other"),
        (-F.col("n.far") / F.lit(float(_ROUNDED))).alias("similarity"),
        (F.col("at") + 1).alias("rank"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's most similar."""
    near = nearest(table(spark, sf_dir, "name_vectors").select("vec_id", "embedding"))
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
with v as (
  select vec_id, embedding::double[64] as e from name_vectors
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.vec_id as a, b.vec_id as b, array_cosine_similarity(a.e, b.e) as sim from v a join v b on a.vec_id <> b.vec_id),
r as (select a, b, row_number() over (partition by a order by round(sim, 6) desc, b) as n from s where sim >= 0.8)
select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from r where n <= 5"""
}
