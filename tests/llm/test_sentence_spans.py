import math
import random
import time

import pytest
from graphloom.llm import sentence_bounds as S

MODEL = {"weights": {"bias.": 0.7, "bias!": 1.2, "m.Upper": 0.8, "m.lower": -2.0}, "lengths": [-1.5, -0.8, -0.2, 0.1, 0.4, 0.5, 0.3, -0.4, -1.0, -1.5]}


def all_pairs(text, model):
    """The same spans by a table over all pairs of places."""
    stop = len(text.rstrip())
    found = [p for p in S.places(text[:stop]) if 0 < p.end < stop]
    whole = S.Place(stop, stop)
    S._depths(text[:stop], [whole])
    starts, depths = [0] + [p.start for p in found], [0] + [p.depth for p in found]
    ends, after = [p.end for p in found] + [stop], [p.depth for p in found] + [whole.depth]
    closing = [sum(model["weights"].get(f, 0.0) for f in p.features) for p in found] + [0.0]
    best, back = [0.0], [0]
    for j in range(len(ends)):
        options = [best[i] + model["lengths"][S._bucket(ends[j] - starts[i])] - S.UNBALANCED * (after[j] != depths[i]) for i in range(j + 1)]
        top = max(options)
        best.append(top + closing[j])
        back.append(options.index(top))
    out, j = [], len(ends)
    while j:
        out.append((starts[back[j]], ends[j - 1]))
        j = back[j]
    return out[::-1], best[-1]


@pytest.mark.parametrize("seed", range(25))
def test_spans_equal_the_table_over_all_pairs(seed):
    r = random.Random(seed)
    words = ["film", "grew", "no", "(see", "it)", '"so', 'said"', "Then", "The", "a" * 300, "cf"]
    text = ""
    for _ in range(r.randint(20, 250)):
        text += r.choice(words) + r.choice([" ", " ", ". ", ". ", "! "])
    spans, best = all_pairs(text, MODEL)
    assert S.segment(text, MODEL) == spans and math.isfinite(best)


def test_long_texts_take_linear_time():
    def took(n):
        began = time.process_time()
        S.segment("No one saw it. " * n, MODEL)
        return time.process_time() - began

    assert took(40_000) < 8 * took(10_000) + 0.5
