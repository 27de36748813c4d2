import random

import pytest
from graphloom.llm import scan_repair as sr
from test_scan_repair import WORDS, editor, prose  # noqa: F401


def test_rows_come_from_the_model(editor):  # noqa: F811
    text = "the measured hard-\nness of fi1m s een\n我们用量热法跟踪了簿膜的硬度。"
    found, _ = sr.defects(text, [], None, editor)
    assert {(0, "broken"), (1, "misread"), (2, "misread")} <= set(found)
    constant = sr.Editor(editor.known, sr.Perceptron(), editor.follows)
    assert sr.defects(text, [], None, constant)[0] == []


def test_unknown_words_that_look_right_are_kept(editor):  # noqa: F811
    assert not editor.misread("hardness")[0]
    assert [editor.misread(w)[0] for w in ("a7", "x12", "9b4")] == [False] * 3


def test_long_words_are_judged(editor):  # noqa: F811
    word = "annealing" * 15
    known = sr.Known.of([word, " ".join(WORDS)])
    own = sr.Editor(known, editor.model, editor.follows)
    assert not own.misread(word)[0]
    assert len(word) > 128
    noisy = word.replace("l", "1", 1)
    assert own.misread(noisy)[:2] == (True, word)


def test_map_grows_with_the_words():
    assert sr.map_bits(1000) == sr.MAP_LEAST and sr.map_bits(5_000_000) == 1 << 27
    with pytest.raises(ValueError):
        sr.map_bits(200_000_000)
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=12)) for _ in range(900_000)]
    known = sr.Known.of([" ".join(words)])
    assert all(w in known for w in words[:2000])
    assert sum("".join(r.choices("qrstuvwxyz", k=12)) in known for _ in range(20_000)) < 60


def test_map_of_a_table_equals_the_map_of_its_texts(spark):
    texts = ["the film-thickness 12 grew", None, "", "薄膜 of ingots"] + [f"word{'abcdefghij'[i % 10] * (i % 7)} n" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sr.known_words(spark, df).raw == sr.Known.of([t for t in texts if t]).raw


def test_no_number_of_heads_and_series_is_too_many(spark):
    """400 pages of one volume: a head for each ten pages and a new series of numbers for each five."""
    pages, r = [], random.Random(8)
    for k in range(400):
        head = f"Chapter of {'abcdefghij'[k // 10 % 10] * 3}{'klmnopqrst'[k // 100] * 4} matter"
        pages.append((f"b{k}", "d", k, k + 1, f"{head}\n" + "\n".join(prose(r, 9) for _ in range(6)) + f"\n{1000 + (k // 5) * 37 + k}"))
    p = spark.createDataFrame(pages, "record_id string, document_id string, block_no int, page_number int, text string")
    marks = sr.paper_marks(p).collect()
    assert sum(len(x.marks) for x in marks) > 128 and max(len(x.marks) for x in marks) < 64
    by = {x.stretch: set(x.marks) for x in marks}
    missed = [k for k, page in enumerate(pages) if sr.furniture(page[4], k + 1, by.get((k + 1) // sr.REACH, set())) != [0, 7]]
    assert missed == [] or len(missed) <= 2 and missed[0] == 0  # the first page's head is the title


def test_edits_are_placed_in_one_pass():
    stream = "ab " * 50_000
    edits = [(i * 3, i * 3 + 1, "x") for i in range(50_000)]
    assert sr._rebuild(stream, edits, [3 * 1000, 3 * 2000])[0].startswith("xb xb") and len(sr._rebuild(stream, edits, [3 * 1000])) == 2
