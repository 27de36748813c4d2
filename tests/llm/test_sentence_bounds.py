import pytest
from graphloom.llm.sentence_bounds import fit, places, segment, train, units

EN = ["The film grew at {k} K.", "We used foils of Type B.", "It fits 3.5 + 2.1 T, see Fig. {k}.", "Adding zinc, e.g. ball milling, helps (cf. Ref. {k}).", "Does it hold at {k} K?", 'They wrote "is it so? it is not." in the margin of sheet {k}.']
DE = ["Die Härte, d. h. {k} GPa, stieg deutlich.", "Am {k}. Tag sank die Dichte.", "Der Wert (vgl. Abb. {k}) lag bei ca. 5 K."]
ZH = ["硬度在{k} K下升高。", "作者写道：“它稳定吗？不稳定。”。", "我们跟踪了{k}号薄膜！"]
TH = ["ความแข็งลดลงที่ {k} MPa", "ความพรุนคงที่หลังอบ {k} ชั่วโมง"]


@pytest.fixture(scope="module")
def model():
    rows = []
    for group in (EN, DE, ZH, TH):
        flat = [t.format(k=k) for k in range(3, 90) for t in group]
        rows += list(zip(flat, flat[1:] + [""]))
    return fit(rows)


@pytest.mark.parametrize("group, gap", [(EN, " "), (DE, " "), (EN, "\n"), (ZH, ""), (TH, " ")])
def test_units_come_back(model, group, gap):
    parts = [t.format(k=100 + i) for i, t in enumerate(group * 2)]
    text = gap.join(parts)
    assert [text[a:b] for a, b in segment(text, model)] == parts


def test_citations_and_closers_stay(model):
    text = "It fits at 5 K.3,4 The film grew at 7 K.[12] The film grew at 9 K.20"
    assert [text[a:b] for a, b in segment(text, model)] == ["It fits at 5 K.3,4", "The film grew at 7 K.[12]", "The film grew at 9 K.20"]
    text = '“The film grew at 7 K.” Does it hold at 8 K? (The film grew at 4 K.) The film grew at 9 K.'
    assert len(segment(text, model)) == 4


def test_units_cover_every_other_character(model):
    for text in ("", "   ", " a ", "G = E - TS\n+ x\n(1)", "One. Two? Three! 四。五", "((( a. B", "x" * 50_000 + ". Y" + " z. The film." * 3000):
        spans = segment(text, model)
        inside = set()
        for a, b in spans:
            assert a < b and text[a:b] == text[a:b].strip()
            assert inside.isdisjoint(range(a, b))
            inside.update(range(a, b))
        assert all(i in inside or text[i].isspace() for i in range(len(text)))


def test_decimals_are_no_places():
    assert places("v. 3.1.2 of 0.5 K") and all(p.end == 2 for p in places("v. 3.1.2 of 0.5 K"))


def test_operator_on_rows(spark, model):
    df = spark.createDataFrame([("a", "The film grew at 5 K. We used foils of Type B.", 1), ("b", None, 2), (None, "one", 3), ("c", "", 4)], "record_id string, text string, start_at int")
    out = [tuple(x) for x in units(df, model).collect()]
    assert ("a", 0, 21) in out and (None, 0, 3) in out and not [x for x in out if x[0] in ("b", "c")]
    assert units(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "document_id string, ordinal int, layer string, text string")
    assert segment("One. Two.", train(empty))
