import random

import pytest
from graphloom.llm import scan_repair as sr

WORDS = "the measured hardness of film was seen after annealing under severe conditions between oxidised layers with coating modulus stress-free fine-grained ingot remained constant near boundary temperature while dilatometry agreed that porosity dropped sharply across powder".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def editor():
    r = random.Random(1)
    texts = [prose(r, 40) for _ in range(200)] + ["我们用量热法跟踪了薄膜的硬度。在干燥空气中，硬度升高。晶粒尺寸超过参考值。"] * 3
    return sr.train(texts, sr.Known.of(texts))


def test_words(editor):
    for noisy, true in (("annealirig", "annealing"), ("fi1m", "film"), ("coatin9", "coating"), ("rnodulus", "modulus"), ("sharp1y", "sharply"), ("ﬁlm", "film"), ("téstperature", None)):
        assert editor.misread(noisy)[:2] == (True, true)
    assert editor.is_known("Annealing") and editor.joins("anneal", "-", "ing") and editor.joins("por", "\xad", "osity")
    assert not editor.joins("stress", "-", "free") and not editor.joins("fine", "-", "grained")


def test_held_out_edits(editor):
    r, right, total = random.Random(9), 0, 0
    for _ in range(300):
        w = r.choice([w for w in WORDS if len(w) > 4 and w.isalpha()])
        spots = [(s, t, i) for s, t in sr.CONFUSIONS for i in range(len(w)) if w.startswith(t, i)]
        if not spots:
            continue
        noisy = sr._corrupt(w, *r.choice(spots))[0]
        if not editor.is_known(noisy):
            total += 1
            right += editor.misread(noisy)[1] == w
    assert right / total > 0.9


def test_lines(editor):
    text = "Archive of Solids 7\nthe measured hard-\nness of stress-\nfree film was s een after\n\nannealirig under severe cond\xad\n12"
    furn = sr.furniture(text, 2, {"N10", *sr.head_keys("Archive of Solids 7")})
    assert furn == [0, 6]
    found, paragraphs = sr.defects(text, furn, "itions", editor)
    assert {(0, "furniture"), (1, "broken"), (3, "misread"), (5, "broken"), (5, "misread"), (6, "furniture")} == set(found)
    assert ("broken" in {d for i, d in found if i == 1}) and not [1 for i, d in found if i == 2]
    assert paragraphs[0].startswith("the measured hardness of stress-free film was seen after")


def test_ideographs(editor):
    found, paragraphs = sr.defects("我们用量热法跟踪\n了簿膜的硬度。", [], None, editor)
    assert found == [(1, "misread")] and paragraphs == ["我们用量热法跟踪了薄膜的硬度。"]
    assert sr.defects("我们用量热法跟踪\n了薄膜的硬度。", [], None, editor)[0] == []


@pytest.mark.parametrize("line, number", [("- 187 -", 187), ("[32]", 32), ("Page l34 of 158", 134), ("· 20l ·", 201), ("viii", 8), ("第 259 页", 259), ("12.5", None), ("(1)", None), ("148 K", None), ("", None)])
def test_page_numbers(line, number):
    assert sr.page_number(line) == number


def test_operator(spark, editor):
    r = random.Random(4)
    pages = [(f"b{k}", "d1", k, k + 1, f"{'Title of the film' if k % 2 else 'Journal of Layers 3'}\n" + "\n".join(prose(r, 8) for _ in range(6)) + f"\n{k + 30}", "x") for k in range(10)]
    pages[4] = ("b4", "d1", 4, 5, "Journal of Layers 3\nthe measured por-\n34", "x")
    pages[5] = ("b5", "d1", 5, 6, "Title of the film\nosity of film\n35", "x")
    pages += [("n1", None, None, None, "no paper\nhere", "x"), ("n2", "d1", 11, 12, None, "x"), ("n3", "d1", 12, 13, "", "x"), pages[0]]
    p = spark.createDataFrame(pages, "record_id string, document_id string, block_no int, page_number int, text string, defect string")
    s = spark.createDataFrame([("s1", "d1", 5, "the measured\n34\nTitle of the film\nhardness of film was seen"), ("s2", None, None, None)], "record_id string, document_id string, page_number int, text string")
    out = {tuple(x) for x in sr.scan_lines(p, s, editor).collect()}
    assert ("b4", 2, "broken") in out and ("b4", 3, "furniture") in out and ("b3", 1, "furniture") in out
    assert {("s1", 2, "furniture"), ("s1", 3, "furniture")} <= out and not [x for x in out if x[0] == "s2"]
    assert not [x for x in out if x[0] == "b5" and x[2] == "misread"]
    texts = {(x.record_id, x.paragraph_no): x.text for x in sr.scan_lines(p, s, editor, repaired=True).collect()}
    assert texts[("b4", 1)] == "the measured porosity"
    assert sr.scan_lines(p.limit(0), s.limit(0), editor).count() == 0


@pytest.mark.parametrize("text", ["", "\n\n", "-", "\xad\n-", "a-\n", "…" * 400, "x" * 30000, "-\n" * 500, "\U0001f600\n1"])
def test_odd_texts(editor, text):
    sr.defects(text, sr.furniture(text, 1, set()), None, editor)
