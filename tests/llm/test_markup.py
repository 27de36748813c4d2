import pytest
from graphloom.llm.markup import KINDS, clean_inline, content_key, elements, features, fit, labelled_pages, seen_leaves, structure

BLOCKS = [
    ("heading", "# Grain size of the film"), ("heading", "Hardness at 4 K"), ("heading", "薄膜的硬度"),
    ("main_text", "The film grew at 4.5 K. It did not recover. No change of hardness was seen after milling."),
    ("abstract", "我们用量热法跟踪了薄膜的硬度。在干燥空气中，硬度升高。"), ("equation", "$$a_{1} = b + c$$"),
]


@pytest.fixture(scope="module")
def model():
    return fit(BLOCKS, 400)


def test_held_out_pages(model):
    right = total = 0
    for text, kinds in labelled_pages(BLOCKS, 150, seed=77):
        found = [x for x, _ in seen_leaves(text)]
        if len(found) == len(kinds):
            right += sum(a == b for a, b in zip(model.decode(features(found)), kinds))
            total += len(kinds)
    assert total > 500 and right / total > 0.97


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("To _first_ [order](https://a.example/x \"n\"), x[^3] <!-- todo --> R&amp;D <110> a > b", "To first order, x R&D <110> a > b"),
        ("The ''near'' [[Topic:X|edge]] {{cite|A|3}}of<ref name=r>A, vol. 3</ref> [https://a.example b] <nowiki>5 * 3</nowiki>", "The near edge of b 5 * 3"),
        ("Adding \\textbf{zinc}~\\cite{a1} and {\\it tin} at 5\\% \\href{https://a.example}{of} X$_2$O$_3$\\label{s}", "Adding zinc and tin at 5% of X_2O_3"),
        ("costs $5 per kg and $E = \\alpha T^{2}$ stage_run_id", "costs $5 per kg and E = \\alpha T^{2} stage_run_id"),
        ('<p>One<br/> <a href="x" target=_blank>two</a>&nbsp;\\(a_{1}\\)</p>', "One two a_{1}"),
    ],
)
def test_inline(raw, clean):
    assert content_key(clean_inline(raw)) == content_key(clean)


def test_dialects(model):
    page = "<h2>One title</h2>\n<ul><li>first\n<li>second <b>x</b></ul><pre><code>a &lt; b</code></pre>\n<p>Text of a paragraph here.</p><script>var x</script>"
    assert elements(page, model) == [("heading", "One title"), ("list_item", "first"), ("list_item", "second x"), ("code", "a < b"), ("paragraph", "Text of a paragraph here.")]
    page = "Title of it\n=====\n\n*Some* text of a paragraph\ngoes on.\n\n- one item\n  - two item\n\n```\n# not a heading\n```\n\n$$\na = b\n$$\n\n[ref]: https://a.example"
    assert [k for k, _ in elements(page, model)] == ["heading", "paragraph", "list_item", "list_item", "code", "formula"]
    page = "\\section{A \\emph{title}}\\label{x}\n\nText of \\textbf{it} here.\n\n% note\n\n\\begin{itemize}\n  \\item one\n  \\item two\n\\end{itemize}\n\n\\begin{equation}\\label{e}\na = b\n\\end{equation}"
    assert elements(page, model) == [("heading", "A title"), ("paragraph", "Text of it here."), ("list_item", "one"), ("list_item", "two"), ("formula", "\na = b\n".strip())]


@pytest.mark.parametrize("text", ["", " ", "<", "<<<>>>", "{{{{", "[[[[", "\\section{", "$$$$", "```", "<!--", "<pre>", "*" * 500, "#\n" * 300, "a" * 20000, "[" * 3000, "\ue000\ue001\U000f0000"])
def test_broken_markup_does_not_crash(model, text):
    elements(text, model)
    clean_inline(text)


def test_rows(spark, model):
    df = spark.createDataFrame([("a", "# T\n\ntext of it.", "x"), ("b", None, "x"), (None, "text here.", "x"), ("c", "", "x"), ("d", "--", "x")], "record_id string, text string, kind string")
    rows = structure(df, model).collect()
    assert {x.record_id for x in rows} == {"a", None} and all(x.kind in KINDS for x in rows)
    assert structure(df, None).count() == 2
    assert structure(df.limit(0), model).count() == 0
    assert fit([], 20).decode([])  == []
