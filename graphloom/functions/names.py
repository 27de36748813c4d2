"""Keys under which names count as equal. Case folding and compatibility forms have no SQL function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GRAPH = re.compile(r"[\s_\-–—]+")
_RESOLUTION = re.compile(r"[\s\-_()（）]+")


def graph_key(value: str) -> str:
    """Compatibility form, case-folded, without white space, underscores, hyphens and dashes."""
    return _GRAPH.sub("", unicodedata.normalize("NFKC", value).casefold().strip())


def resolution_key(value: str) -> str:
    """Without white space, hyphens, underscores and round brackets, case-folded; no compatibility form."""
    return _RESOLUTION.sub("", value).casefold()


@F.pandas_udf(T.StringType())
def _graph(values: pd.Series) -> pd.Series:
    return values.map(graph_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def _resolution(values: pd.Series) -> pd.Series:
    return values.map(resolution_key, na_action="ignore")


def graph_key_of(c: Column) -> Column:
    return _graph(c)


def resolution_key_of(c: Column) -> Column:
    return _resolution(c)


def aliases_of(c: Column) -> Column:
    """The entries of a JSON list; anything unreadable has none. Null entries are left out."""
    read = F.try_variant_get(F.try_parse_json(c), "$", "array<string>")
    return F.filter(F.coalesce(read, F.array().cast("array<string>")), lambda x: x.isNotNull())


def by_length(aliases: Column) -> Column:
    """Distinct names, shortest first, then by value."""
    keyed = F.transform(F.array_distinct(aliases), lambda x: F.struct(F.length(x).alias("n"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])
