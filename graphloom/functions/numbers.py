"""Scores, vectors and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_WEIGHT, CONTEXT_WEIGHT = 0.7, 0.3
AUTO_MERGE, CANDIDATE = 0.99, 0.85
# Names of agreement below each bound, of none and of the rest (fixed values).
KAPPA_LABELS = ((0.0, "低于随机一致"), (0.2, "轻微一致"), (0.4, "一般一致"), (0.6, "中等一致"), (0.8, "较强一致"))
KAPPA_UNDEFINED, KAPPA_HIGHEST = "无法计算", "高度一致"


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of two arrays."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def total_score(name: Column, context: Column, same_name: Column) -> Column:
    """Weighted similarity, 1 for equal names and never above."""
    return F.when(same_name, F.lit(1.0)).otherwise(F.least(F.lit(1.0), name * NAME_WEIGHT + context * CONTEXT_WEIGHT))


def similarity_class(score: Column, auto: float = AUTO_MERGE, candidate: float = CANDIDATE) -> Column:
    """auto_merge, candidate or ignore."""
    return F.when(score >= auto, "auto_merge").when(score >= candidate, "candidate").otherwise("ignore")


def kappa_label(kappa: Column) -> Column:
    """A word for an agreement; null has its own."""
    out = F.when(kappa.isNull(), KAPPA_UNDEFINED)
    for below, name in KAPPA_LABELS:
        out = out.when(kappa < below, name)
    return out.otherwise(KAPPA_HIGHEST)


def percent(share: Column, digits: int = 2) -> Column:
    """A share as a percentage text, rounded half to even on the stored value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.concat(F.call_function("format_number", share.cast("double") * 100, F.lit(pattern)), F.lit("%"))


def node_radius(mentions: Column) -> Column:
    """Drawn size of a node with so many mentions."""
    return F.least(F.lit(15.0), F.lit(7.0) + 2.0 * F.log2(mentions.cast("double") + 1.0))
