"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of the rank file; a parameter of every operator that measures text.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern published with these vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level encoder of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as ranks:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


#: Runs without white space or punctuation are merged in quadratic time: longer texts go in pieces cut
#: before a space, where no token crosses.
_PIECE = 200_000


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; null and empty texts have none."""
    if not text:
        return 0
    encode = encoder(path).encode_ordinary
    if len(text) <= _PIECE:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            # a space between two letters starts a new token whatever stands around
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end += 1
        total, at = total + len(encode(text[at:end])), end
    return total


def with_tokens(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and n_tokens, one row per input row; other columns never leave the scan."""
    rows = documents.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(x, tokenizer) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema)
