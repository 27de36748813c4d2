import time

import pytest
from graphloom.llm.markup import clean_inline, content_key, elements, features, fit, labelled_pages, leaves, seen_leaves, structure
from test_markup import BLOCKS


@pytest.fixture(scope="module")
def model():
    return fit(BLOCKS, 500)


def test_leaves_carry_all_their_ancestors():
    found = leaves("<div><ul><li><p>first</p></li><li>second<ul><li>inner</li></ul></li></ul><blockquote><h2>Said</h2><p>so</p></blockquote>after</div>")
    assert [(x.tag, x.path) for x in found] == [
        ("p", ("div", "ul", "li", "p")), ("li", ("div", "ul", "li")), ("li", ("div", "ul", "li", "ul", "li")),
        ("h2", ("div", "blockquote", "h2")), ("p", ("div", "blockquote", "p")), ("div", ("div",)),
    ]
    found = leaves("<table><tr><td>a<td><p>b</p><tr><th>c</table>\n\nplain")
    assert [(x.text.strip(), x.path) for x in found] == [("a", ("table", "tr", "td")), ("b", ("table", "tr", "td", "p")), ("c", ("table", "tr", "th")), ("plain", ())]
    found = leaves("\\begin{quote}\n\\begin{itemize}\n\\item one\n\\end{itemize}\ntext of it\n\\end{quote}\nbehind")
    assert [(x.tag, x.path) for x in found] == [("item", ("quote", "itemize")), ("text", ("quote",)), ("text", ())]
    names = features(leaves("<ul><li><p>first</p></li></ul>"))[0]
    assert {"under=ul", "under=li", "p|under=li", "path=ul>li>p|p"} <= set(names)


def test_kinds_follow_from_ancestors(model):
    assert elements("<ul><li><p>the first of the items</p></li><li><p>the second of the items</p></li></ul>", model) == [
        ("list_item", "the first of the items"), ("list_item", "the second of the items")]
    assert [k for k, _ in elements("<blockquote><h2>Grain size</h2><p>The film grew at 4 K. It did not recover.</p></blockquote>", model)] == ["heading", "paragraph"]
    assert elements("<div><pre>x = 1</pre></div>", model) == [("code", "x = 1")]


def test_a_field_without_weights_finds_other_kinds(model):
    from graphloom.llm.crf import Crf
    from graphloom.llm.markup import KINDS

    page = "<ul><li><p>the first</p></li></ul><h2>Grain size</h2><p>The film grew at 4 K.</p>"
    assert elements(page, Crf(KINDS)) != elements(page, model)


def test_marks_of_private_use_stay_and_crash_nothing(spark, model):
    assert clean_inline("icon \ue0005\ue001 and $a+b$") == "icon \ue0005\ue001 and a+b"
    assert clean_inline("icon &#xE000;5&#xE001; and $a+b$") == "icon \ue0005\ue001 and a+b"
    text = "icon \ue0000\ue001 and \U000f0000\n\n```\ncode\n```\n\n\U000f0000"
    assert [k for k, _ in elements(text, model)] == ["paragraph", "code"]
    rows = structure(spark.createDataFrame([("a", "\ue0009\ue001 $x$")], "record_id string, text string"), None).collect()
    assert rows[0].clean_text == "\ue0009\ue001 x"


def test_no_number_of_cut_outs_is_too_many(model):
    text = "~~~\nx\n~~~\n" * 140_000
    assert len(leaves(text)) == 140_000
    text = " ".join(f"$a_{i}$" for i in range(9000))
    assert content_key(clean_inline(text)) == content_key("".join(f"a{i}" for i in range(9000))) and clean_inline(text).count("a_") == 9000


@pytest.mark.parametrize("piece", ["\\section{A title}\n", "<pre>\n", "<script>", "\\begin{verbatim}\n", "\\( a ", "<ref>", "<math>x", "\\section{open\n", "<div class=math>", "{{", "[[File:"])
def test_time_grows_with_the_text(piece):
    def took(n):
        began = time.process_time()
        seen_leaves(piece * n)
        return time.process_time() - began

    small, large = took(2500), took(10_000)
    assert large < 8 * small + 0.5


def test_held_out_pages_with_nesting(model):
    right = total = 0
    for text, kinds in labelled_pages(BLOCKS, 200, seed=99):
        found = [x for x, _ in seen_leaves(text)]
        if len(found) == len(kinds):
            right += sum(a == b for a, b in zip(model.decode(features(found)), kinds))
            total += len(kinds)
    assert total > 600 and right / total > 0.97
