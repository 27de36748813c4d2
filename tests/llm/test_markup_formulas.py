from graphloom.llm.markup import clean_inline


def test_every_formula_of_a_long_text_comes_back():
    text = " ".join(f"x $a_{{{i}}}$ <nowiki>*{i}*</nowiki>" for i in range(5000))
    assert clean_inline(text) == " ".join(f"x a_{{{i}}} *{i}*" for i in range(5000))
