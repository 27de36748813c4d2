"""Repeated content inside a single document (problem 8).

Compression bands: zstandard, set to take nothing but matches as long as a window, packs the fixed chunks
of a text and then the whole text. Its ratio says how much of the text lies in matches. Above its upper
limit a text is repetitive, below the lower limit of its length it can't be; both verdicts are the bands'
own. Only what lies between the limits is measured window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import table

WINDOW = 30
SHARE = 0.25
#: Bytes of a fixed chunk.
CHUNK_BYTES = 1 << 16
#: (bytes up to, lower limit). Matches can't overlap, so of windows that overlap each other only about
#: every second is packed: a text of which a quarter repeats has at least an eighth in matches, each of
#: which costs a few bytes. The limits lie below what that leaves; tests/llm draws such texts. Beyond the
#: last length the match table no longer holds every place, and no ratio is low enough.
LOWER = ((512, 1.02), (2048, 1.05), (1 << 24, 1.08))
#: Every match is at least a window long, so its characters are repeated: at this ratio a quarter of the
#: bytes are, whatever the length. Where a character takes two bytes, a match may begin and end inside
#: one, and the limit asks for two fifths.
UPPER, UPPER_WIDE = 4 / 3, 5 / 3
_PAD = bytes(range(240, 256))  # matches are sought up to a few bytes before the end
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Lower case, one space for each run of white space, trimmed."""
    return " ".join(text.lower().split())


def repeated_share(text: str, window: int = WINDOW) -> float:
    """Share of the characters of a normalised text inside a window seen earlier in the same text.

    Windows are compared by a 64-bit rolling hash; the hash and the place are sorted together.
    """
    n = len(text)
    if n <= window:
        return 0.0
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    x += np.uint64(1)
    h = _window_hashes(x, window)
    m = len(h)
    bits = np.uint64(max(1, int(m - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~mask) | np.arange(m, dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) <= mask
    if not same.any():
        return 0.0
    later = (key[1:] & mask)[same].astype(np.int64)
    earlier = (key[:-1] & mask)[same].astype(np.int64)
    later = later[h[later] == h[earlier]]
    if not len(later):
        return 0.0
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[later] += 1  # each place occurs once
    edge[later + window] -= 1
    return float(np.count_nonzero(np.cumsum(edge[:n]) > 0)) / n


def _window_hashes(x: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes of all windows, built from windows of powers of two."""
    powers, width = [(1, x)], 1
    while width * 2 <= window:
        at = powers[-1][1]
        base = np.uint64(pow(int(_BASE), width, 1 << 64))
        powers.append((width * 2, at[:-width] * base + at[width:]))
        width *= 2
    left, start, h = window, 0, None
    size = len(x) - window + 1
    for width, part in reversed(powers):
        if width <= left:
            piece = part[start : start + size]
            h = piece.copy() if h is None else h * np.uint64(pow(int(_BASE), width, 1 << 64)) + piece
            start, left = start + width, left - width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def encoded(text: str) -> tuple[bytes, int]:
    """A text in a fixed number of bytes a character, and that number; rare planes take two units."""
    try:
        return text.encode("latin-1"), 1
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass"), 2


def _packer(log: int, least: int) -> zstandard.ZstdCompressor:
    """A compressor with a match table for 2^log places, for matches of ``least`` bytes and more only."""
    parts = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_FAST, target_length=131072, min_match=7, hash_log=6, chain_log=6, search_log=1,
        window_log=log, enable_ldm=True, ldm_hash_log=log, ldm_bucket_size_log=3, ldm_min_match=least, write_content_size=False,
    )
    return zstandard.ZstdCompressor(compression_params=parts)


_small_packer = lru_cache(maxsize=32)(_packer)


def packed_size(data: bytes, least: int) -> int:
    """Bytes that are left of ``data`` when matches of at least ``least`` bytes are packed."""
    log = min(24, max(10, (len(data) + len(_PAD)).bit_length()))
    packer = _small_packer(log, least) if log <= 20 else _packer(log, least)
    return len(packer.compress(data + _PAD)) - len(_PAD)


def chunk_ratio(data: bytes, least: int, chunk: int = CHUNK_BYTES) -> float:
    """The ratio of all fixed chunks of a text, each packed for itself."""
    return len(data) / sum(packed_size(data[i : i + chunk], least) for i in range(0, len(data), chunk)) if data else 0.0


def lower_limit(n_bytes: int) -> float:
    """The ratio below which a text of this length can't be repetitive."""
    return next((limit for most, limit in LOWER if n_bytes <= most), 0.0)


def bands(text: str, window: int = WINDOW, chunk: int = CHUNK_BYTES) -> tuple[float, float, bool | None]:
    """(chunk ratio, whole-text ratio, verdict) of a normalised text; the verdict is None between the limits.

    A text whose chunks alone pass the upper limit isn't packed as a whole: its whole-text ratio is NaN.
    """
    if len(text) <= window:
        return 0.0, 0.0, False
    data, width = encoded(text)
    upper = UPPER if width == 1 else UPPER_WIDE
    parts = chunk_ratio(data, window * width, chunk)
    if parts >= upper:
        return parts, float("nan"), True
    whole = parts if len(data) <= chunk else len(data) / packed_size(data, window * width)
    return parts, whole, True if whole >= upper else False if whole < lower_limit(len(data)) else None


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_normalised", pa.int32()),
        ("chunk_ratio", pa.float64()),
        ("whole_ratio", pa.float64()),
        ("settled_by_band", pa.bool_()),
        ("is_repetitive", pa.bool_()),
        ("repeated_share", pa.float64()),
    ]
)


def _measure(measure_all: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _OUT]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clean = normalise(text) if text else ""
                parts, whole, verdict = bands(clean, window)
                share = repeated_share(clean, window) if measure_all or verdict is None else None
                found = verdict if verdict is not None else share >= SHARE
                for column, value in zip(rows, (doc_id, len(clean), parts, whole, verdict is not None, found, share)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _OUT)], schema=_OUT)

    return run


def repetition(documents: DataFrame, measure_all: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per document: its compression ratios, the verdict, and where measured its repeated share.

    The bands settle what lies outside their limits; the share is null there unless ``measure_all``. A
    null text counts as empty, and an empty or short text (up to ``window`` characters) isn't repetitive.
    Repeated input rows stay repeated; a null doc_id is kept. Further columns of ``documents`` are
    ignored, so their names can't clash.
    """
    cols = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return cols.mapInArrow(
        _measure(measure_all, window),
        "doc_id bigint, n_normalised int, chunk_ratio double, whole_ratio double, settled_by_band boolean, is_repetitive boolean, repeated_share double",
    )


def p8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every row of documents."""
    out = repetition(table(spark, sf_dir, "documents"), measure_all=True)
    return out.select("doc_id", "n_normalised", F.round("repeated_share", 6).alias("repeated_share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose repeated share is at least a quarter."""
    return repetition(table(spark, sf_dir, "documents")).where("is_repetitive").select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_repetition": p8_repetition}

_WS = r"[ \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_SHARES = f"""
with n as (select distinct doc_id, trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'), ' ') as t from documents where length(text) > 30),
w as (select doc_id, length(t) as size, i, substring(t, i, 30) as piece from (select doc_id, t, unnest(range(1, length(t) - 28)) as i from n where length(t) > 30)),
r as (select doc_id, size, i from (select *, min(i) over (partition by doc_id, piece) as first from w) where i > first),
c as (select doc_id, size, least(30, coalesce(lead(i) over (partition by doc_id order by i) - i, 30)) as covered from r)"""

SQL = {
    "p8_found": f"{_SHARES} select doc_id from c group by doc_id, size having sum(covered) >= 0.25 * size",
    "p8_repetition": f"""{_SHARES}, g as (select doc_id, sum(covered) as covered from c group by doc_id)
select d.doc_id, coalesce(length(trim(regexp_replace(lower(d.text), '{_WS}', ' ', 'g'), ' ')), 0)::int as n_normalised,
  case when g.covered is null then 0.0 else round(g.covered / length(trim(regexp_replace(lower(d.text), '{_WS}', ' ', 'g'), ' '))::double, 6) end as repeated_share
from documents d left join g using (doc_id)""",
}
