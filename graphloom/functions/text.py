"""Text functions as column expressions.

Java patterns carry (?U) wherever white space, digits or word edges must follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, words and patterns that results depend on.
SENTENCE_CLOSERS = "。！？!?；;"
MATH_MARKS = "=<>≤≥≈≃≡+−–*/×÷^_∑∏∫∂√∞±∇∆ΔλμσπωαβγθφψχΩ"
STRONG_MATH_MARKS = "=<>≤≥≈≃≡∑∏∫∂√∞±∇∆ΔλμσπωαβγθφψχΩ"
RELATIONS = "=≤≥≈≃≡<>"
LATEX_COMMANDS = ("frac", "sum", "int", "partial", "sqrt", "Delta", "lambda", "mu", "sigma", "omega", "alpha", "beta", "gamma")
NARRATIVE_CUES = ("where", "depends", "determined", "shown", "figure", "represents")
SKIPPED_BLOCK_TYPES = ("page_header", "page_footer", "page_number", "page_aside_text", "header", "footer", "aside_text", "image", "chart", "table")
EQUATION_TYPES = ("equation", "interline_equation", "display_equation")
REFERENCE_HEADER = r"(?iU)^\s*#{0,6}\s*(?:references|bibliography)(?:\s+and\s+notes?)?\s*:?\s*$"
REFERENCE_ENTRY = r"(?mU)^\s*[*†‡§¶#]*\s*\[\d+\]\s+"
METADATA_LINE = r"(?iU)^\s*(?:received|revised|accepted|published)\s*:\s*|^\s*(?:https?://)?(?:dx\.)?doi\.org/|^\s*downloaded\s+via\b"
FRONT_MATTER = r"(?iU)^\s*(?:keywords?|cite\s+this|read\s+online|access|metrics\s*&\s*more|article\s+recommendations?|supporting\s+information)\b"
SENTENCE_END = r"(?U)(?:[.!?。！？；;]|[.!?][\]\)\"']|\$)\s*(?:\d+(?:[,\-−–]\d+)*)?\s*$"
_SPLIT = "␞"


def ustrip(c: Column) -> Column:
    """Unicode white space off both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeezed(c: Column) -> Column:
    """Runs of spaces and tabs as one space, white space off the ends."""
    return ustrip(F.regexp_replace(c, r"[ \t]+", " "))


def sentences_of(c: Column) -> Column:
    """The sentences of a text as an array: unwraps lines, joins cut words, then splits behind closing marks.

    Full-width marks, ! and ? and semicolons split with or without white space, a full stop only before
    white space and a capital or digit; citation numbers behind a mark stay with their sentence.
    """
    flat = F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))
    flat = F.regexp_replace(flat, r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[a-z])", "")
    flat = squeezed(F.regexp_replace(flat, r"[ \t]*\n[ \t]*", " "))
    cited = F.regexp_replace(flat, r"(?U)([.!?])(\d+(?:[−\-–,]\d+)*)\s+(?=[A-Z])", f"$1$2{_SPLIT}")
    cut = rf"(?U){_SPLIT}|(?<=[{SENTENCE_CLOSERS}])\s*|(?<=\.)\s+(?=[A-Z0-9])"
    return F.filter(F.transform(F.split(cited, cut), ustrip), lambda x: x != "")


def is_equation_number(c: Column) -> Column:
    """A number, or a letter with digits, with or without round brackets, in at most 10 characters."""
    bare = ustrip(c)
    return (F.length(bare) > 0) & (F.length(bare) <= 10) & bare.rlike(r"(?U)^\(?\s*(?:\d+|[A-Za-z]\d*)\s*\)?$")


def is_formula(c: Column) -> Column:
    """Whether a line reads as a display formula; narrative words, bare numbers and long lines don't."""
    s = ustrip(c)
    marks = F.regexp_count(s, F.lit(f"[{MATH_MARKS}]"))
    strong = F.regexp_count(s, F.lit(f"[{STRONG_MATH_MARKS}]"))
    substance = F.regexp_count(s, F.lit(r"[A-Za-z0-9Ͱ-Ͽ一-鿿]"))
    words = F.regexp_count(s, F.lit(r"[A-Za-z]{3,}|[一-鿿]{2,}"))
    relation = s.rlike(f"[{RELATIONS}]")
    latex = s.rlike(r"(?U)\\(?:" + "|".join(LATEX_COMMANDS) + r")\b")
    label = s.rlike(r"(?U)\(\s*\d+[a-zA-Z]?\s*\)\s*$")
    low = F.lower(s)
    cues = low.rlike(r"(?U)\b(?:" + "|".join(NARRATIVE_CUES) + r")\b") | low.rlike(r"(?U)\bw +h +e +r +e\b")
    halves = F.split(s, f"[{RELATIONS}]", 2)
    operand = r"[A-Za-z0-9Ͱ-Ͽ]"
    sided = ~relation | (F.get(halves, 0).rlike(operand) & F.get(halves, 1).rlike(operand))
    shape = latex | (relation & (words <= 10)) | ((strong >= 1) & (marks >= 2) & (words <= 5)) | (label & (marks >= 1))
    verdict = (F.length(s) > 0) & (F.length(s) <= 500) & ~is_equation_number(s) & ~cues & sided & (substance >= 2) & shape
    return F.coalesce(verdict, F.lit(False))


def clean_markdown(c: Column) -> Column:
    """Presentation blocks dropped, replacement characters and hard spaces mended, at most one blank line."""
    out = F.regexp_replace(c, r"(?is)<details>.*?</details>", "")
    out = F.regexp_replace(out, r"(?is)<summary>.*?</summary>", "")
    out = F.translate(out, "� ", "- ")
    return ustrip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def is_references(c: Column) -> Column:
    """A heading of references, or at least three numbered entries over three lines."""
    return c.rlike(REFERENCE_HEADER) | (
        (F.regexp_count(c, F.lit(REFERENCE_ENTRY)) >= 3) & (F.regexp_count(c, F.lit("\n")) >= 2)
    )


def ends_sentence(c: Column) -> Column:
    """Whether a text ends with a closing mark, bracket or formula, citation numbers aside."""
    return c.rlike(SENTENCE_END)


def block_category(block_type: Column, c: Column) -> Column:
    """heading, equation, abstract or main_text."""
    return (
        F.when((block_type == "title") | c.rlike(r"(?U)^\s*#"), "heading")
        .when(block_type.isin(*EQUATION_TYPES), "equation")
        .when(c.rlike(r"(?sU)^\s*(?:\$\$.+\$\$|\$[^$]{10,}\$)\s*$"), "equation")
        .when(c.rlike(r"(?iU)^\s*abstract\s*:?"), "abstract")
        .otherwise("main_text")
    )


def chunks_by_blank_line(c: Column) -> Column:
    """Paragraphs between blank lines; every line separator counts as one."""
    lines = F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return F.filter(F.transform(F.split(lines, r"(?U)\n(?:[^\S\n]*\n)+"), ustrip), lambda x: x != "")


def evidence_text(role: Column, before: Column, current: Column, after: Column) -> Column:
    """The text a mention was found in; a missing or empty neighbour gives way to the sentence."""
    picked = F.when(role == "previous", before).when(role == "next", after).when(role == "current", current)
    return F.coalesce(F.nullif(picked, F.lit("")), current)


def humanized(c: Column) -> Column:
    """HAS_PROPERTY as Has Property."""
    return F.array_join(F.transform(F.split(F.lower(c), "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), " ")


def shortened(c: Column, most: int = 24, kept: int = 22) -> Column:
    """A label cut to ``kept`` characters and an ellipsis where longer than ``most``."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit("…"))).otherwise(c)


def color_slot(c: Column, slots: int = 8) -> Column:
    """The palette slot of a type name: the size of a 31-multiplier hash in signed 32 bits, modulo ``slots``."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x).bitwiseAND(0xFFFFFFFF))
    return (F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % slots).cast("int")


def template(pattern: str, **values: Column) -> Column:
    """{name} places of a pattern filled from columns; null values leave an empty place."""
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
