import random

import pytest
from graphloom.llm.repetition import normalise, repeated_share, repetition


def brute(text, window=30):
    n = len(text)
    if n <= window:
        return 0.0
    seen, mark = set(), [0] * n
    for i in range(n - window + 1):
        piece = text[i : i + window]
        if piece in seen:
            mark[i : i + window] = [1] * window
        seen.add(piece)
    return sum(mark) / n


@pytest.mark.parametrize("seed", range(40))
def test_share_equals_brute_force(seed):
    r = random.Random(seed)
    alphabet = r.choice(["ab", "abcdefgh ", "文字列比較的"])
    parts = ["".join(r.choices(alphabet, k=r.randint(1, 80))) for _ in range(5)]
    text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
    assert repeated_share(text) == pytest.approx(brute(text))


def test_edges():
    assert repeated_share("") == 0.0
    assert repeated_share("a" * 30) == 0.0
    assert repeated_share("a" * 31) == pytest.approx(30 / 31)
    assert normalise(" A\t\nb C ") == "a b c"


def test_rows_with_nulls_empties_and_repeats(spark):
    long = ("The same sentence again and again. " * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, repeated_share string")
    out = repetition(df).collect()
    assert len(out) == 5
    assert all(x.is_repetitive == (x.doc_id == 3) for x in out)
    out = repetition(df, measure_all=True).collect()
    assert all(x.repeated_share > 0.9 for x in out if x.doc_id == 3)
    assert all(x.repeated_share == 0 for x in out if x.doc_id != 3)
    assert repetition(df.limit(0)).count() == 0
