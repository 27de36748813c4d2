import re

import pytest
from graphloom.functions import names, numbers
from graphloom.functions import text as X
from graphloom.operators import units
from pyspark.sql import functions as F


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One grew. Two fell.", ["One grew.", "Two fell."]),
        ("第一句。第二句！第三", ["第一句。", "第二句！", "第三"]),
        ("A wrapped hyphen-\nated word\nhere. Next", ["A wrapped hyphenated word here.", "Next"]),
        ("It held.12 Then it fell.", ["It held.12", "Then it fell."]),
        ("e.g. lower stays. 3 does not", ["e.g. lower stays.", "3 does not"]),
        ("a; b；c", ["a;", "b；", "c"]),
        ("  \n ", []),
        ("", []),
        (None, None),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, text, X.sentences_of) == parts


@pytest.mark.parametrize("text, yes", [("a = b + c", True), ("(3)", False), ("where a = b", False), ("= b", False), ("\\frac{a}{b} and", True), ("plain words only", False), ("E ≥ 5 kT", True), ("x" * 600 + " = 1", False), ("", False), (None, False), ("w h e r e x = 2", False)])
def test_formula(spark, text, yes):
    assert one(spark, text, X.is_formula) is yes


@pytest.mark.parametrize("text, yes", [("(12)", True), ("A", True), ("B2", True), ("12345678901", False), ("ab", False), ("", False)])
def test_equation_number(spark, text, yes):
    assert one(spark, text, X.is_equation_number) is yes


def test_small_functions(spark):
    assert one(spark, "HAS_PROPERTY", X.humanized) == "Has Property"
    assert one(spark, "x" * 30, X.shortened) == "x" * 22 + "…"
    assert one(spark, "<details>a\nb</details>x\ufffdy\u00a0z\n\n\n\nq ", X.clean_markdown) == "x-y z\n\nq"
    assert one(spark, "## References and Notes:", X.is_references) is True
    assert one(spark, "[1] a\n[2] b\n[3] c", X.is_references) is True
    assert one(spark, "done).", X.ends_sentence) is True and one(spark, "open", X.ends_sentence) is False
    assert one(spark, "a\x0bb\x0b\x0bc", X.chunks_by_blank_line) == ["a\nb", "c"]

    def color(name):
        h = 0
        for ch in name:
            h = (h * 31 + ord(ch) + (1 << 31)) % (1 << 32) - (1 << 31)  # signed 32 bits
        return abs(h) % 8

    for name in ("Material", "Instrument", "Mechanism", "Structure", "x"):
        assert one(spark, name, X.color_slot) == color(name)
    assert one(spark, "HAS_some thing_X", X.humanized) == "Has Some thing X"
    assert one(spark, "a = b w here c", X.is_formula) is True and one(spark, "a = b w h e r e c", X.is_formula) is False


def test_names():
    assert names.graph_key(" Ａb–c_d-e ") == "abcde" and names.graph_key("Straße") == "strasse"
    assert names.resolution_key("A (b)-（c）_d–e") == "abcd–e"


def test_alias_reading(spark):
    for raw, want in (('["a", "b"]', ["a", "b"]), ('["a", "b"', []), ("null", []), (None, []), ('{"a":1}', []), ("", [])):
        assert one(spark, raw, names.aliases_of) == want
    assert spark.range(1).select(names.by_length(F.array(F.lit("ccc"), F.lit("b"), F.lit("aa"), F.lit("b")))).head()[0] == ["b", "aa", "ccc"]


def test_scores(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert row.select(numbers.cosine(F.col("a"), F.col("b"))).head()[0] == pytest.approx(24 / (5 * 106**0.5))  # the longer vector keeps its whole norm
    assert row.select(numbers.cosine(F.col("a"), F.col("z"))).head()[0] == 0
    scores = spark.createDataFrame([(0.999,), (0.99,), (0.989,), (0.85,), (0.849,)], "s double")
    assert [r[0] for r in scores.select(numbers.similarity_class(F.col("s"))).collect()] == ["auto_merge", "auto_merge", "candidate", "candidate", "ignore"]
    assert spark.createDataFrame([(0.93755,)], "s double").select(numbers.percent(F.col("s"))).head()[0] == f"{0.93755:.2%}"


def runs_model(lines):
    out = []
    for line in lines:
        kind = "f" if "=" in line else "n" if re.fullmatch(r"\(\d\)", line) else "p"
        formula = kind == "f" or (kind == "n" and bool(out) and out[-1][0])
        if out and out[-1][0] == formula:
            out[-1][1].append(line)
        else:
            out.append((formula, [line]))
    return [(f, "\n".join(x)) for f, x in out]


def test_line_runs_against_a_sequential_model(spark):
    import itertools

    cases = [list(c) for n in range(1, 5) for c in itertools.product(["a = b", "(1)", "some prose"], repeat=n)]
    df = spark.createDataFrame([(str(i), "\n".join(c), "x") for i, c in enumerate(cases)], "block_id string, text string, run_no string")
    got = {}
    for r in units.line_runs(df).orderBy("block_id", "run_no").collect():
        got.setdefault(int(r.block_id), []).append((r.is_formula, r.run_text))
    assert all(got[i] == runs_model(c) for i, c in enumerate(cases))


def test_context(spark):
    rows = [("d", 0, "Some prose here."), ("d", 1, "a = b"), ("d", 2, "c = d"), ("d", 3, "More prose."), ("e", 0, "Alone.")]
    out = {(r.document_id, r.ordinal): (r.before, r.after) for r in units.with_context(spark.createDataFrame(rows, "document_id string, ordinal int, text string")).collect()}
    assert out[("d", 1)] == out[("d", 2)] == ("Some prose here.", "More prose.")
    assert out[("d", 0)] == (None, "a = b") and out[("e", 0)] == (None, None)
