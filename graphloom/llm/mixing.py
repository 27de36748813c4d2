"""Mixing sources to target weights (problem 7).

Entropy balancing: document rates stay as near to one copy each as they can, in entropy weighted by what
a document is worth, while every source's tokens meet its share. The dual is convex, with one multiplier
a source, and its solution tilts rates exponentially in a feature of the document. Newton steps sum
gradient and curvature over a histogram of the documents; the tilted rates are then rounded into copies
along each source's documents ordered by size.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.tokens import TOKENIZER, with_tokens
from graphloom.runtime import materialise, table

#: Documents rounded in one run; a source of more is cut into so many runs.
RUN = 4096
STEPS = 60
TOLERANCE = 1e-10
#: Tokens added to a document's own in its weight: leaving a text out, or repeating it, counts by its
#: tokens and by being a text, so that short texts move less than long ones.
HELD = 64
MOST_SOURCES = 100_000


def tilt_of(n_tokens: Column) -> Column:
    """The feature of a document its rate is tilted by: its tokens over its weight, from 0 to nearly 1."""
    return n_tokens / (n_tokens + F.lit(float(HELD)))


def solve_dual(histogram: DataFrame, wanted: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Multipliers l with sum(t * min(cap, exp(l * tilt(t)))) = wanted, a source each, by guarded Newton steps.

    ``histogram``: source, n_tokens, n. Minimising sum (t + HELD) * (w ln w - w) over the rates w under
    the token constraints gives w = exp(l * t / (t + HELD)); the cap cuts it off. Each step is one
    aggregation over the histogram; only two sums per source come to the driver, and every source steps
    at once. A step that leaves the bracket of the root halves it. A source asked for all its cap allows
    has the multiplier infinity.
    """
    spark = histogram.sparkSession
    at = {s: math.inf for s in wanted}
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    sums = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()
    for r in sums:
        if r.source in wanted and 0 < wanted[r.source] < caps[r.source] * r.t * (1 - 1e-12):
            at[r.source] = math.log(wanted[r.source] / r.t)
    pending = {s for s, x in at.items() if x < math.inf}
    for _ in range(STEPS):
        if not pending:
            break
        rates = spark.createDataFrame([(s, at[s], float(caps[s])) for s in sorted(pending)], "source string, l double, cap double")
        tilted = histogram.join(F.broadcast(rates), "source").withColumn("x", F.col("l") * tilt_of(F.col("n_tokens")))
        free = F.col("x") < F.log("cap")
        mass = F.col("n") * F.col("n_tokens") * F.when(free, F.exp("x")).otherwise(F.col("cap"))
        sums = tilted.groupBy("source").agg(
            F.sum(mass).alias("tokens"), F.sum(F.when(free, mass * tilt_of(F.col("n_tokens"))).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():
            s, gap = r.source, wanted[r.source] - r.tokens
            if abs(gap) <= TOLERANCE * max(wanted[s], 1.0):
                pending.discard(s)
                continue
            if gap > 0:
                low[s] = at[s]
            else:
                high[s] = at[s]
            new = at[s] + gap / r.slope if r.slope > 0 else math.nan
            if not low[s] < new < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    new = at[s] + math.copysign(max(1.0, abs(at[s])), gap)
                else:
                    new = (low[s] + high[s]) / 2
            at[s] = new
    return at


def feasible_total(available: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """The largest total at which every source can give its share within its cap."""
    return min((caps[s] * available[s] / shares[s] for s in shares), default=0.0)


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies), a row per input row; copies never exceed max_repeats.

    The total is the largest at which all shares can be met, or ``total_tokens``; a source that can't
    give its share of a given total gives all that its cap allows. Documents without a source, of a
    source without a target or with a share or cap of 0 get no copy, and a source without tokens gives
    its share to the others in proportion. Null and empty texts have 0 tokens, so no tilt, and go in
    once. Repeated rows are rounded each for itself. Of a repeated target the largest share counts.
    """
    rows = targets.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("int").alias("cap")
    )
    goals = rows.where("source is not null and share > 0 and cap > 0").limit(MOST_SOURCES + 1).collect()
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    # numbered, so that rows alike in everything still part over the runs
    picked = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text", F.monotonically_increasing_id().alias("row_no"))
    measured = materialise(with_tokens(picked, ["doc_id", "source", "row_no"], tokenizer=tokenizer), "tokens")
    histogram = materialise(measured.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "sizes")
    totals = {
        r.source: (r.t, r.n)
        for r in histogram.where(F.col("source").isin([g.source for g in goals]))
        .groupBy("source")
        .agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n"))
        .collect()
    }
    found = [g for g in goals if totals.get(g.source, (0, 0))[0] > 0]
    norm = sum(g.share for g in found)
    shares = {g.source: g.share / norm for g in found}
    caps = {g.source: g.cap for g in found}
    available = {s: totals[s][0] for s in shares}
    total = feasible_total(available, shares, caps) if total_tokens is None else total_tokens
    wanted = {s: min(shares[s] * total, caps[s] * available[s]) for s in shares}
    tilt = solve_dual(histogram, wanted, caps) if shares else {}
    spark = documents.sparkSession
    multipliers = spark.createDataFrame(
        [(s, float(tilt[s]), caps[s], max(1, -(-totals[s][1] // RUN))) for s in shares], "source string, l double, cap int, runs int"
    )
    # a multiplier of infinity asks every document for its cap, those without tokens, and without tilt, for one copy
    rate = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.least(F.exp(F.col("l") * tilt_of(F.col("n_tokens"))), F.col("cap").cast("double")))
    rated = measured.join(F.broadcast(multipliers), "source", "left").withColumn("rate", F.when(F.col("cap").isNotNull(), rate))
    in_mix = rated.where("rate is not null").withColumn("mix", F.xxhash64("row_no", F.lit(7))).withColumn("run", F.pmod("mix", F.col("runs")))
    named = ["doc_id", "source", "n_tokens", "rate"]
    rounded = in_mix.select(*named, "cap", "run", "mix").groupBy("source", "run").applyInArrow(
        _round_run, "doc_id bigint, source string, n_tokens bigint, rate double, copies int"
    )
    left_out = rated.where("rate is null").select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return rounded.unionByName(left_out)


def round_rates(sizes: list[int], rates: list[float], cap: int, start: float) -> list[int]:
    """Copies of documents in descending size, each floor or ceiling of its rate, tracking the rates' tokens.

    What one document is given too much or too little is carried to the next, so the tokens of a run
    miss the rates' by about the size of its last documents; ``start`` in [0, 1) shifts which are taken.
    """
    carried = (start - 0.5) * (sizes[-1] if sizes else 0)
    turn, out = start, []
    for size, rate in zip(sizes, rates):
        low = min(cap, math.floor(rate + 1e-9))
        part = max(0.0, rate - low) if low < cap else 0.0
        carried += size * part
        turn += part
        if size == 0:  # no tokens to track: every 1/part-th
            extra = int(turn) > int(turn - part)
        else:
            extra = part > 0 and 2 * carried >= size
        carried -= size * extra
        out.append(low + extra)
    return out


def _round_run(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("n_tokens", "descending"), ("mix", "ascending")])
    start = (zlib.crc32(f"{rows.column('source')[0]}-{rows.column('run')[0]}".encode()) % 1009) / 1009
    copies = round_rates(rows.column("n_tokens").to_pylist(), rows.column("rate").to_pylist(), rows.column("cap")[0].as_py(), start)
    return rows.select(["doc_id", "source", "n_tokens", "rate"]).append_column("copies", pa.array(copies, pa.int32()))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share per source, sources without documents or target included."""
    per_source = mixed.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").alias("available_tokens"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"),
    )
    goals = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = goals.join(per_source, F.expr("true") & goals["source"].eqNullSafe(per_source["source"]), "full").select(
        F.coalesce(goals["source"], per_source["source"]).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "available_tokens", "mixed_tokens", "most_copies")],
    )
    total = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # a row per source
    return both.withColumn("actual_share", F.coalesce(F.round(F.try_divide("mixed_tokens", total), 6), F.lit(0.0)))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mixture."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reaches, to three places, and whether any document is repeated too often."""
    reached = shares(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets")).where("target_share > 0")
    return reached.select(
        "source", "target_share", "max_repeats", "documents", (F.col("most_copies") > F.col("max_repeats")).alias("is_over"),
        F.round("actual_share", 3).alias("actual_share"),
    )


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}

SQL = {
    # sources without a document leave their share to the others; the total is chosen so that each can be met
    "p7_shares": """with d as (select source, count(*) as n, count(*) filter (length(text) > 0) as held from documents group by 1),
j as (select t.source, t.target_share, t.max_repeats, coalesce(d.n, 0) as documents, coalesce(d.held, 0) > 0 as held from mix_targets t left join d using (source) where t.target_share > 0)
select source, target_share, max_repeats, documents, false as is_over, case when held then round(target_share / sum(target_share) filter (held) over (), 3) else 0.0 end as actual_share from j"""
}
