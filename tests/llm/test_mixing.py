import math
import random

import pytest
from graphloom.llm.mixing import HELD, feasible_total, mixture, round_rates, shares, solve_dual


def test_rounding_tracks_tokens():
    r = random.Random(1)
    sizes = sorted((int(r.paretovariate(1.1) * 50) for _ in range(900)), reverse=True)
    for rate, cap in ((0.3, 1), (1.7, 3), (2.0, 2), (0.02, 1), (3.0, 3)):
        copies = round_rates(sizes, [rate] * len(sizes), cap, 0.4)
        assert max(copies) <= cap and min(copies) >= math.floor(rate)
        assert abs(sum(c * s for c, s in zip(copies, sizes)) - rate * sum(sizes)) <= max(0.01 * rate * sum(sizes), sizes[-1])
    assert round_rates([], [], 1, 0.1) == []
    assert sum(round_rates([0] * 10, [0.5] * 10, 1, 0.1)) == 5


def test_rounding_tracks_tilted_rates():
    r = random.Random(2)
    sizes = sorted((int(r.paretovariate(1.1) * 50) for _ in range(900)), reverse=True)
    rates = [min(3.0, math.exp(1.3 * t / (t + 64))) for t in sizes]
    copies = round_rates(sizes, rates, 3, 0.4)
    assert all(math.floor(w + 1e-9) <= c <= math.ceil(w) for c, w in zip(copies, rates))
    assert abs(sum(c * s for c, s in zip(copies, sizes)) - sum(w * s for w, s in zip(rates, sizes))) <= sizes[-1] * 3


def test_dual(spark):
    sizes = [("a", 10, 5), ("a", 100, 2), ("b", 50, 4), ("c", 20, 10), ("c", 900, 1), ("d", 10, 3)]
    h = spark.createDataFrame(sizes, "source string, n_tokens bigint, n bigint")
    wanted, caps = {"a": 75.0, "b": 600.0, "c": 2150.0, "d": 0.001}, {"a": 1.0, "b": 3.0, "c": 2.0, "d": 1.0}
    tilt = solve_dual(h, wanted, caps)
    assert tilt["b"] == math.inf
    rate = lambda s, t: min(caps[s], math.exp(tilt[s] * t / (t + HELD)))
    for s in "acd":
        assert sum(n * t * rate(s, t) for x, t, n in sizes if x == s) == pytest.approx(wanted[s], rel=1e-8)
    assert rate("a", 100) < rate("a", 10) < 1  # a long text gives way before a short one
    assert rate("c", 900) == 2.0 and 1 < rate("c", 20) < 2.0  # the cap cuts the tilt off, the others make up for it


def test_total():
    assert feasible_total({"a": 100, "b": 50}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) == 200
    assert feasible_total({}, {}, {}) == 0


def test_mixture(spark):
    text = "wear rate of the coating "
    docs = [(i, text * (1 + i % 7), "big" if i % 3 else "small", 1.0) for i in range(600)]
    docs += [(900, None, "big", 1.0), (901, "", "small", 1.0), (902, text, None, 1.0), (903, text, "other", 1.0), (None, text, "big", 1.0), (0, text, "small", 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, rate double")
    targets = spark.createDataFrame(
        [("big", 0.5, 1), ("small", 0.3, 2), ("absent", 0.2, 4), ("zero", 0.0, 1), (None, 0.1, 1)],
        "source string, target_share double, max_repeats int",
    )
    out = mixture(df, targets)
    rows = out.collect()
    assert len(rows) == len(docs)
    assert all(x.copies <= {"big": 1, "small": 2}.get(x.source, 0) for x in rows)
    got = {x.source: x.actual_share for x in shares(out, targets).collect()}
    assert got["big"] == pytest.approx(0.625, abs=0.01) and got["small"] == pytest.approx(0.375, abs=0.01)
    assert got["absent"] == 0 and got["other"] == 0
    assert mixture(df.limit(0), targets).count() == 0
    assert {x.copies for x in mixture(df, targets.limit(0)).collect()} == {0}
    capped = shares(mixture(df, targets, total_tokens=1e9), targets)
    assert {x.source: x.most_copies for x in capped.collect()}["small"] == 2


def test_rates_are_tilted_by_document_and_rows_alike_part_over_runs(spark, monkeypatch):
    from graphloom.llm import mixing

    text = "wear rate of the coating "
    rows = [(None, text * (1 + i % 5), "big") for i in range(400)] + [(i, text, "small") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "RUN", 50)
    out = mixture(df, targets).collect()
    rates = {x.n_tokens: round(x.rate, 6) for x in out if x.source == "big"}
    assert len(set(rates.values())) == 5 and rates[min(rates)] == max(rates.values())
    big = [x for x in out if x.source == "big"]
    assert abs(sum(x.copies * x.n_tokens for x in big) - sum(x.rate * x.n_tokens for x in big)) < 10 * max(rates)
    assert all(x.copies == 3 for x in out if x.source == "small")
