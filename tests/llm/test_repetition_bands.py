import random

import pytest
from graphloom.llm import repetition as R

ASCII = [chr(c) for c in range(33, 127) if not chr(c).isupper()]
TWO_BYTES = [c for c in map(chr, range(0xA1, 0x7FF)) if c == c.lower() and not c.isspace()]
IDEOGRAPHS = [chr(c) for c in range(0x4E00, 0x9FA5)]


def far_repeats(r, size, share=0.26, chars=TWO_BYTES):
    """Evenly drawn characters; all over the second half, pieces of 30 to 64 of the first."""
    fresh, pieces, left = "".join(r.choices(chars, k=int(size * (1 - share)))), [], int(size * share)
    half = len(fresh) // 2
    while left > 0:
        n, at = r.randint(30, 64), r.randrange(half - 64)
        pieces.append(fresh[at : at + n])
        left -= n
    gap = half // len(pieces)
    return fresh[:half] + "".join(p + fresh[half + i * gap : half + (i + 1) * gap] for i, p in enumerate(pieces))


def overlapping_windows(r, size, chars, share=0.28):
    """Repeated windows of 30 from all over the text, each overlapping the next by one: the least that matches can pack."""
    pieces = []
    for _ in range(int(size * share / 29) + 1):
        piece = "".join(r.choices(chars, k=30))
        pieces.append((pieces[-1][29] if pieces else piece[0]) + piece[1:])
    gap = max(0, size - 59 * len(pieces)) // (len(pieces) + 1)
    order = r.sample(range(len(pieces)), len(pieces))
    return "".join("".join(r.choices(chars, k=gap)) + pieces[i] for i in order) + pieces[0] + "".join(p[1:] for p in pieces[1:])


@pytest.mark.parametrize("size", [400, 600, 1200, 1900, 60_000, 100_000, 128_000])
def test_repeats_over_two_byte_alphabets_stay_inside(size):
    for seed in range(12):
        text = far_repeats(random.Random(seed), size)
        assert R.repeated_share(text) < 0.25 or R.bands(text)[2] is not False


@pytest.mark.parametrize("chars", [ASCII, TWO_BYTES, IDEOGRAPHS, list("ab")])
@pytest.mark.parametrize("size", [61, 90, 130, 200, 300, 500, 700, 1500, 3000, 20_000, 200_000])
def test_windows_that_overlap_stay_inside(size, chars):
    for seed in range(8 if size < 100_000 else 2):
        text = overlapping_windows(random.Random(seed), size, chars)
        assert R.repeated_share(text) >= 0.25 and R.bands(text)[2] is not False


@pytest.mark.parametrize("seed", range(40))
def test_bands_never_contradict_the_exact_share(seed):
    r = random.Random(seed)
    chars = r.choice([ASCII, TWO_BYTES, IDEOGRAPHS, list("abc ")])
    size = r.choice([80, 200, 700, 3000, 30_000])
    text = "".join(r.choices(chars, k=size))
    for _ in range(r.randint(0, size // 40)):
        at, to = r.randrange(len(text)), r.randrange(len(text))
        text = text[:to] + text[at : at + r.choice([20, 31, 40, 90])] + text[to:]
    verdict = R.bands(text)[2]
    assert verdict is None or verdict == (R.repeated_share(text) >= R.SHARE)


def test_bands_settle_plain_and_spammed_texts():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(900)]
    plain = " ".join(r.choices(words, k=3000))
    assert R.bands(plain)[2] is False
    assert R.bands("buy it now from our shop. " * 40)[2] is True
    parts, whole, verdict = R.bands(plain[:9000] + ("no change was seen in any of the films. " * 300), chunk=4096)
    assert verdict is True and parts >= R.UPPER and whole != whole
    far = plain[:15_000] + plain[:15_000]
    parts, whole, verdict = R.bands(far, chunk=4096)
    assert parts < 1.02 and whole >= R.UPPER and verdict is True  # no chunk repeats itself, the whole does


def test_rows_come_from_the_bands(spark, monkeypatch):
    text = "the same sentence again and again. " * 30
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = R.repetition(df).collect()[0]
    assert row.settled_by_band and row.is_repetitive and row.repeated_share is None
    row = R.repetition(df, measure_all=True).collect()[0]
    assert row.is_repetitive and row.repeated_share > 0.9


def test_lower_limits_end_where_the_match_table_does():
    assert R.lower_limit(1 << 24) > 1 and R.lower_limit((1 << 24) + 1) == 0.0
