"""Registered queries over the stored tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import names, numbers
from graphloom.functions import text as X
from graphloom.operators import agreement, annotate, blocks, embed, graph, ingest, maintain, resolve, spans, suggest, units
from graphloom.operators import current as C
from graphloom.operators.current import REVIEWED, with_sql
from graphloom.runtime import table
from graphloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Fragments of SQL -----------------------------------------------------------------------------------

_WS = r"[ \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _units(x: str) -> str:
    flat = rf"replace(replace({x}, chr(160), ' '), chr(13) || chr(10), chr(10))"
    for _ in range(2):
        flat = rf"regexp_replace({flat}, '([A-Za-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g')"
    flat = _strip(rf"regexp_replace(regexp_replace({flat}, '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]+', ' ', 'g')")
    for _ in range(2):
        flat = rf"regexp_replace({flat}, '([.!?])(\p{{Nd}}+(?:[−\-–,]\p{{Nd}}+)*){_WS}+([A-Z])', '\1\2␞\3', 'g')"
    flat = rf"regexp_replace({flat}, '([。！？!?；;]){_WS}*', '\1␞', 'g')"
    for _ in range(2):
        flat = rf"regexp_replace({flat}, '(\.){_WS}+([A-Z0-9])', '\1␞\2', 'g')"
    return f"list_filter(list_transform(string_split({flat}, '␞'), lambda u: {_strip('u')}), lambda u: u <> '')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _number(x: str) -> str:
    s = _strip(x)
    return rf"(length({s}) between 1 and 10 and regexp_matches({s}, '^\(?{_WS}*(?:\p{{Nd}}+|[A-Za-z]\p{{Nd}}*){_WS}*\)?$'))"


def _formula(x: str) -> str:
    s = _strip(x)
    rel = "[=≤≥≈≃≡<>]"
    operand = "[A-Za-z0-9Ͱ-Ͽ]"
    words = _count(s, "[A-Za-z]{3,}|[一-鿿]{2,}")
    latex = rf"regexp_matches({s}, '\\(?:{'|'.join(X.LATEX_COMMANDS)})(?:[^\p{{L}}\p{{N}}_]|$)')"
    cue = rf"regexp_matches(lower({s}), '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(X.NARRATIVE_CUES)})(?:[^\p{{L}}\p{{N}}_]|$)') or regexp_matches(lower({s}), '(?:^|[^\p{{L}}\p{{N}}_])w +h +e +r +e(?:[^\p{{L}}\p{{N}}_]|$)')"
    marks, strong = _count(s, f"[{X.MATH_MARKS}]"), _count(s, f"[{X.STRONG_MATH_MARKS}]")
    label = rf"regexp_matches({s}, '\({_WS}*\p{{Nd}}+[a-zA-Z]?{_WS}*\){_WS}*$')"
    sides = rf"(not regexp_matches({s}, '{rel}') or (regexp_matches(regexp_extract({s}, '^([^=≤≥≈≃≡<>]*){rel}', 1), '{operand}') and regexp_matches(regexp_extract({s}, '^[^=≤≥≈≃≡<>]*{rel}([\s\S]*)$', 1), '{operand}')))"
    return (
        f"(length({s}) between 1 and 500 and not {_number(x)} and not ({cue}) and {sides} and {_count(s, '[A-Za-z0-9Ͱ-Ͽ一-鿿]')} >= 2 and "
        f"({latex} or (regexp_matches({s}, '{rel}') and {words} <= 10) or ({strong} >= 1 and {marks} >= 2 and {words} <= 5) or ({label} and {marks} >= 1)))"
    )


_ALIASES = """case when json_valid({0}) and json_type({0}) = 'ARRAY' then list_filter(from_json({0}, '["VARCHAR"]'), lambda x: x is not null) else []::varchar[] end"""


def _clean(x: str) -> str:
    return _strip(f"regexp_replace(replace(replace(regexp_replace(regexp_replace({x}, '(?is)<details>.*?</details>', '', 'g'), '(?is)<summary>.*?</summary>', '', 'g'), chr(65533), '-'), chr(160), ' '), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")


_METADATA = r"(?i)^\s*(?:received|revised|accepted|published)\s*:\s*|^\s*(?:https?://)?(?:dx\.)?doi\.org/|^\s*downloaded\s+via\b"
_FRONT = r"(?i)^\s*(?:keywords?|cite\s+this|read\s+online|access|metrics\s*&\s*more|article\s+recommendations?|supporting\s+information)\b"
_REFERENCES = r"(regexp_matches(text, '(?i)^\s*#{0,6}\s*(?:references|bibliography)(?:\s+and\s+notes?)?\s*:?\s*$') or (len(regexp_extract_all(text, '(?m)^\s*[*†‡§¶#]*\s*\[\d+\]\s+')) >= 3 and len(regexp_extract_all(text, '\n')) >= 2))"
_STOP = "regexp_matches(text, '[.!?。！？]')"


def _category(kind: str) -> str:
    return (
        rf"case when {kind} = 'title' or regexp_matches(text, '^\s*#') then 'heading' when {kind} = 'equation' then 'equation' "
        r"when regexp_matches(text, '^\s*(?s:\$\$.+\$\$|\$[^$]{10,}\$)\s*$') then 'equation' when regexp_matches(text, '(?i)^\s*abstract\s*:?') then 'abstract' else 'main_text' end"
    )


#: A paper's parsed blocks after each gate, the last in ``gb``.
_GATED = rf"""pb as (select document_id, block_no, page_number, bbox, case category when 'heading' then 'title' when 'equation' then 'equation' else 'text' end as kind, {_clean("text")} as text from structured_blocks where layer = 'digital'),
g1 as (select *, max((kind = 'title')::int) over (partition by document_id order by block_no) as titled from pb where text <> '' and not regexp_matches(text, '{_METADATA}')),
g2 as (select * from g1 where titled = 1 or not (contains(lower(text), 'doi.org') or regexp_matches(text, '(?i)\bjournal\b|(?:https?://|www\.|\b\w+\.\w+\.\w+/)') or (kind <> 'equation' and length(text) < 30 and not {_STOP}))),
g3 as (select *, max({_REFERENCES}::int) over (partition by document_id order by block_no) as refs from g2 where not regexp_matches(text, '{_FRONT}')),
g4 as (select *, {_category("kind")} as category, kind <> 'title' and titled = 1 and length(text) < 200 and not {_STOP} as weak from g3 where refs = 0),
g5 as (select *, coalesce(max((category in ('abstract', 'main_text') and length(text) >= 100 and not weak)::int) over (partition by document_id order by block_no rows between unbounded preceding and 1 preceding), 0) as body from g4),
gb as (select document_id, block_no, page_number, category, text, bbox from g5 where not weak or body = 1)"""


def _merged_sql(source: str) -> str:
    """Paragraph fragments of ``source`` joined, in ``mb``; needs WITH RECURSIVE."""
    return rf"""fb as (select *, category in ('heading', 'equation') as alone,
  regexp_matches(text, '(?:[.!?。！？；;]|[.!?][\])"'']|\$){_WS}*(?:\p{{Nd}}+(?:[,\-−–]\p{{Nd}}+)*)?{_WS}*$') as closes from {source}),
fs as (select *, alone or coalesce(lag(alone or closes) over (partition by document_id order by block_no), true) as starts from fb),
fi as (select *, sum(starts::int) over (partition by document_id order by block_no) as island from fs),
fo as (select *, row_number() over (partition by document_id, island order by block_no) as nth, count(*) over (partition by document_id, island) as many from fi),
fj as (select document_id, island, nth, many, block_no, page_number, category, bbox, text as joined from fo where nth = 1
  union all
  select o.document_id, o.island, o.nth, o.many, f.block_no, f.page_number, f.category, f.bbox, {_strip(rf"(case when regexp_matches(f.joined, '[A-Za-z]-{_WS}*$') then regexp_replace(f.joined, '-{_WS}*$', '') else f.joined || ' ' end) || o.text")}
  from fj f join fo o on o.document_id = f.document_id and o.island = f.island and o.nth = f.nth + 1),
mb as (select document_id, block_no, page_number, category, joined as text, bbox from fj where nth = many)"""




def _attribute(x: str) -> str:
    return f"""replace(replace(replace(({x})::varchar, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')"""


def _element(tag: str, attributes: dict[str, str], values: dict[str, str]) -> str:
    """The SQL of a GEXF element with its values."""
    parts = "".join(f"""<attvalue for="{k}" value="' || {_attribute(v)} || '"/>""" for k, v in values.items())
    named = "".join(f""" {k}="' || {_attribute(v)} || '\"""" for k, v in attributes.items())
    return f"'<{tag}{named}><attvalues>{parts}</attvalues></{tag}>' || chr(10)"


_GEXF_NODE = _element("node", {"id": "node_id", "label": "name"}, {k: k for k in ("entity_type", "aliases", "mention_count", "document_count")})
_GEXF_EDGE = _element("edge", {"id": "edge_no", "source": "source_id", "target": "target_id", "label": "relation_type", "weight": "evidence_count"}, {k: k for k in ("relation_type", "evidence_count")})
_EVIDENCE = "coalesce(nullif(case m.context_role when 'previous' then s.context_before when 'next' then s.context_after when 'current' then s.text end, ''), s.text)"
_NODE = "coalesce(nullif(m.canonical_entity_id, ''), m.id)"
_GRAPH_KEY = rf"regexp_replace(replace(lower(translate(nfkc_or_self, '（）', '()')), 'ß', 'ss'), '{_WS}|[_\-–—]', '', 'g')"
_BY_LENGTH = "list_transform(list_sort(list_transform(list_distinct({0}), lambda x: {{'n': length(x), 'name': x}})), lambda x: x.name)"


# Units and text -------------------------------------------------------------------------------------


@query(f"select doc_id, (pos - 1)::int as ordinal, unit from (select doc_id, unnest(u) as unit, generate_subscripts(u, 1) as pos from (select doc_id, {_units('text')} as u from documents))")
def sentence_units(spark, sf_dir):
    """FN3, WN3: the sentences of every document with their order."""
    return units.sentence_units(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(with_sql("s", f"select id as sentence_id, {_number('text')} as is_number, {_formula('text')} as is_formula, case when {_formula('text')} then 'formula' else 'sentence' end as content_type from s"))
def formula_flags(spark, sf_dir):
    """FN4, FN5, PRJ2: which rows are formulas or bare numbers."""
    s = C.sentences(spark, sf_dir)
    f = X.is_formula(F.col("text"))
    return s.select(F.col("id").alias("sentence_id"), X.is_equation_number(F.col("text")).alias("is_number"), f.alias("is_formula"), F.when(f, "formula").otherwise("sentence").alias("content_type"))


_LINE_RUNS = f"""with l as (select block_id, unnest(x) as line, generate_subscripts(x, 1) as pos from (
  select block_id, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda y: {_strip("regexp_replace(y, '[ " + chr(92) + "t]+', ' ', 'g')")}), lambda y: y <> '') as x
  from structured_blocks where layer = 'digital')),
k as (select *, case when {_formula("line")} then 'f' when {_number("line")} then 'n' else 'p' end as kind from l),
g as (select *, coalesce(last_value(case when kind <> 'n' then kind end ignore nulls) over (partition by block_id order by pos), 'p') as eff from k),
b as (select *, case when lag(eff) over w is distinct from eff then 1 else 0 end as s from g window w as (partition by block_id order by pos)),
i as (select *, sum(s) over (partition by block_id order by pos) as run from b)"""


@query(f"""{_LINE_RUNS}
select block_id, (run - 1)::int as run_no, eff = 'f' as is_formula, string_agg(line, chr(10) order by pos) as run_text from i group by block_id, run, eff""")
def line_runs(spark, sf_dir):
    """WN9: runs of formula lines and of prose lines inside each digital block."""
    return units.line_runs(table(spark, sf_dir, "structured_blocks").where("layer = 'digital'").select("block_id", "text"))


@query(
    f"""{_LINE_RUNS}, u as (select block_id, run, is_formula, unnest(x) as unit, generate_subscripts(x, 1) as pos from (
  select block_id, run, eff = 'f' as is_formula, case when eff = 'f' then [string_agg(line, chr(10) order by pos)] else {_units("string_agg(line, chr(10) order by pos)")} end as x from i group by block_id, run, eff))
select block_id, (row_number() over (partition by block_id order by run, pos) - 1)::int as ordinal, unit, is_formula from u"""
)
def block_units(spark, sf_dir):
    """FN6: formula runs and sentences of each digital block (tested against a sequential model)."""
    return units.block_units(table(spark, sf_dir, "structured_blocks").where("layer = 'digital'").select("block_id", "text"))


@query(
    with_sql(
        "s",
        f"""f as (select id, document_id, ordinal, text, {_formula("text")} as is_formula from s),
g as (select *, case when not is_formula then text end as prose from f)
select id as sentence_id, is_formula,
  case when is_formula then last_value(prose ignore nulls) over (partition by document_id order by ordinal, text rows between unbounded preceding and 1 preceding) else lag(text) over (partition by document_id order by ordinal, text) end as before,
  case when is_formula then first_value(prose ignore nulls) over (partition by document_id order by ordinal, text rows between 1 following and unbounded following) else lead(text) over (partition by document_id order by ordinal, text) end as after
from g""",
    )
)
def unit_context(spark, sf_dir):
    """WN1, WN2: each unit's neighbours; formulas see the nearest prose."""
    s = C.sentences(spark, sf_dir).select(F.col("id").alias("sentence_id"), "document_id", "ordinal", "text")
    return units.with_context(s).select("sentence_id", "is_formula", "before", "after")


@query(
    f"""select doc_id, {_strip("regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<details>.*?</details>', '', 'g'), '(?is)<summary>.*?</summary>', '', 'g'), chr(65533), '-'), chr(160), ' '), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as clean from documents"""
)
def clean_text(spark, sf_dir):
    """FN9: documents without presentation residue."""
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(F.col("text")).alias("clean"))


@query(
    rf"""with d as (select doc_id, text from documents where text is not null),
c as (select doc_id, unnest(x) as chunk, generate_subscripts(x, 1) as pos from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n(?:[ \t]*\n)+'), lambda y: {_strip("y")}), lambda y: y <> '') as x from d)),
f as (select *, regexp_matches(chunk, '(?i)^\s*#{{0,6}}\s*(?:references|bibliography)(?:\s+and\s+notes?)?\s*:?\s*$') or (len(regexp_extract_all(chunk, '(?m)^\s*[*†‡§¶#]*\s*\[\d+\]\s+')) >= 3 and len(regexp_extract_all(chunk, '\n')) >= 2) as ref from c),
g as (select *, max(ref::int) over (partition by doc_id order by pos) as seen from f)
select doc_id, (pos - 1)::int as block_no, chunk as text from g where seen = 0"""
)
def references_cut(spark, sf_dir):
    """FN10, FN11, WN6: paragraphs up to a document's list of references."""
    return blocks.before_references(table(spark, sf_dir, "documents"), "doc_id")


def _parsed(spark, sf_dir):
    b = table(spark, sf_dir, "structured_blocks").where("layer = 'digital'")
    kind = F.when(F.col("category") == "heading", "title").when(F.col("category") == "equation", "equation").otherwise("text")
    return b.select("document_id", "block_no", "page_number", kind.alias("block_type"), "text", "bbox")


@query(
    rf"""with recursive b as (select document_id, block_no, page_number, category, text, category in ('heading', 'equation') as alone,
  regexp_matches(text, '(?:[.!?。！？；;]|[.!?][\])"'']|\$){_WS}*(?:\p{{Nd}}+(?:[,\-−–]\p{{Nd}}+)*)?{_WS}*$') as closes from structured_blocks where layer = 'digital'),
s as (select *, alone or coalesce(lag(alone or closes) over (partition by document_id order by block_no), true) as starts from b),
i as (select *, sum(starts::int) over (partition by document_id order by block_no) as island from s),
o as (select *, row_number() over (partition by document_id, island order by block_no) as nth from i),
f as (select document_id, island, nth, text as joined from o where nth = 1
  union all
  select o.document_id, o.island, o.nth, {_strip(rf"(case when regexp_matches(f.joined, '[A-Za-z]-{_WS}*$') then regexp_replace(f.joined, '-{_WS}*$', '') else f.joined || ' ' end) || o.text")}
  from f join o on o.document_id = f.document_id and o.island = f.island and o.nth = f.nth + 1)
select o.document_id, min(o.block_no)::int as block_no, arg_min(o.page_number, o.block_no) as page_number, arg_min(o.category, o.block_no) as category,
  (select arg_max(joined, nth) from f where f.document_id = o.document_id and f.island = o.island) as text, count(*)::int as fragments
from o group by o.document_id, o.island"""
)
def paragraph_merge(spark, sf_dir):
    """WN8: paragraph fragments joined until a sentence ends."""
    b = table(spark, sf_dir, "structured_blocks").where("layer = 'digital'").select("document_id", "block_no", "page_number", "category", "text")
    return blocks.merged(b)


@query(f"with {_GATED} select document_id, block_no, page_number, category, text from gb")
def gated_blocks(spark, sf_dir):
    """FN12, FN17-FN19, WN7: blocks that belong to a paper's content (tested against a sequential model)."""
    return blocks.gated(_parsed(spark, sf_dir)).select("document_id", "block_no", "page_number", "category", "text")


@query(
    rf"""with recursive {_GATED}, {_merged_sql("gb")},
k1 as (select document_id, block_no, category, {_clean("text")} as text from mb),
k2 as (select *, {_strip("regexp_replace(text, '^#+" + _WS + "*', '')")} as head from k1 where text <> ''),
k3 as (select *, row_number() over (partition by document_id, category order by block_no) as nth from k2 where category <> 'heading' or head <> '')
select document_id, {_strip(r"""string_agg(case category when 'heading' then case when nth = 1 then '# ' else '## ' end || head
  when 'abstract' then case when nth = 1 then '## Abstract' || chr(10) || chr(10) else '' end || regexp_replace(text, '(?i)^\s*abstract\s*:?\s*', '') else text end, chr(10) || chr(10) order by block_no)""")} || chr(10) as markdown
from k3 group by document_id"""
)
def clean_markdown(spark, sf_dir):
    """FN22, WN10, SNK6: every digital paper as clean Markdown."""
    return blocks.clean_document(blocks.merged(blocks.gated(_parsed(spark, sf_dir))))


@query(
    rf"""with c as (select document_id, unnest(x) as text, generate_subscripts(x, 1) as pos from (select doc_id::varchar as document_id, list_filter(list_transform(regexp_split_to_array({_clean("text")}, '\n(?:[ \t]*\n)+'), lambda y: {_strip("y")}), lambda y: y <> '') as x from documents where text is not null)),
k as (select *, max({_REFERENCES}::int) over (partition by document_id order by pos) as refs from c where not regexp_matches(text, '{_METADATA}') and not regexp_matches(text, '{_FRONT}')),
t as (select *, case when starts_with(text, '#') then 'title' else 'paragraph' end as block_type from k where refs = 0 and not regexp_matches(text, '(?i)!\[[^\]]*\]\([^)]+\)|<table\b') and not regexp_matches(text, '(?i)^\s*(?:fig(?:ure)?\.?|table)\s*\d+\b'))
select document_id, (pos - 1)::int as block_no, 1 as page_number, block_type, text, {_category("block_type")} as category from t"""
)
def markdown_blocks(spark, sf_dir):
    """FN21: blocks of whole Markdown texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return blocks.markdown_blocks(d)


@query(
    r"""select block_id, case when regexp_matches(text, '^\s*#') then 'heading'
  when regexp_matches(text, '^\s*(?s:\$\$.+\$\$|\$[^$]{10,}\$)\s*$') then 'equation' when regexp_matches(text, '(?i)^\s*abstract\s*:?') then 'abstract' else 'main_text' end as category
from structured_blocks where text is not null"""
)
def block_categories(spark, sf_dir):
    """FN17: what a block's own text says it is."""
    b = table(spark, sf_dir, "structured_blocks").where("text is not null")
    return b.select("block_id", X.block_category(F.lit("text"), F.col("text")).alias("category"))


def placed_tokens(spark, sf_dir):
    """The tokens of every digital equation as spans of a page of its own, a wide gap behind every ninth."""
    b = table(spark, sf_dir, "structured_blocks").where("layer = 'digital' and category = 'equation'")
    t = b.select("document_id", F.col("block_no").alias("page_number"), F.posexplode(F.split(F.replace("text", F.lit("$"), F.lit("")), " ")).alias("span_no", "text"))
    x = 40.0 + 14 * F.col("span_no") + 30 * F.floor(F.col("span_no") / 9)
    font = F.when(F.col("text").rlike("^[A-Za-z]$"), "Times-Italic").otherwise("Times")
    return t.select("*", F.lit(4000.0).alias("page_width"), font.alias("font"), F.lit(10.0).alias("size"), x.alias("x0"), F.lit(100.0).alias("y0"), (x + 10).alias("x1"), F.lit(108.0).alias("y1"))


@query(
    rf"""with t as (select document_id, block_no as page_number, unnest(x) as text, generate_subscripts(x, 1) - 1 as span_no from (select document_id, block_no, string_split(replace(text, '$', ''), ' ') as x from structured_blocks where layer = 'digital' and category = 'equation')),
p as (select *, 40.0 + 14 * span_no + 30 * (span_no // 9) as x0, lower({_strip("text")}) not in ('as', 'in', 'of', 'to', 'is', 'at', 'on', 'by', 'or', 'where', 'depends') and
  (regexp_matches(text, '^[A-Za-z]$') or {_strip("text")} in ('', 'ln', 'log', 'exp', 'sin', 'cos', 'tan', 'd') or regexp_full_match({_strip("text")}, '[A-Za-z]{{1,2}}|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[(),.\[\]{{}}+−–=*/×÷^_<>≤≥≈≃≡±]+')) as math from t where text <> '' and 40.0 + 14 * span_no + 30 * (span_no // 9) < 4000),
b as (select p.*, s.span_no as seed_no from p join p s on s.document_id = p.document_id and s.page_number = p.page_number and regexp_matches(s.text, '[=≤≥≈≃≡]') and (p.x0 < 2000) = (s.x0 < 2000)),
g as (select *, coalesce(x0 - lag(x0 + 10) over w < 18, true) as lft, coalesce(lead(x0) over w - x0 - 10 < 18, true) as rgt from b window w as (partition by document_id, page_number, seed_no order by x0)),
k as (select *, case when span_no = seed_no then 0 when span_no > seed_no then (not (math and lft))::int else (not (math and rgt))::int end as breaks from g),
r as (select *, case when span_no >= seed_no then sum(case when span_no >= seed_no then breaks else 0 end) over (partition by document_id, page_number, seed_no order by x0)
  else sum(case when span_no < seed_no then breaks else 0 end) over (partition by document_id, page_number, seed_no order by x0 rows between current row and unbounded following) end as reach from k),
j as (select document_id, page_number, seed_no, string_agg(text, '' order by x0) as joined, min(x0)::double as x0, max(x0 + 10)::double as x1 from r where reach = 0 group by 1, 2, 3),
f as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(joined, '(?is)(,?{_WS}+where\b|,?{_WS}+as{_WS}+).*$', ''), '{_WS}+', '', 'g'), '([=≤≥≈≃≡<>])', ' \1 ', 'g'), ' +', ' ', 'g'), ' ,') as formula from j)
select document_id, page_number, seed_no::int as seed_no, formula, x0, x1 from f where {_formula("formula")} qualify row_number() over (partition by document_id, page_number, formula order by seed_no) = 1"""
)
def page_formulas(spark, sf_dir):
    """WN11-WN13, FN7, FN8, FN39: formulas rebuilt from placed spans."""
    return spans.page_formulas(placed_tokens(spark, sf_dir)).select("document_id", "page_number", "seed_no", "formula", "x0", "x1")


# Listings and statistics ----------------------------------------------------------------------------


@query(
    with_sql(
        "p s",
        """t as (select document_id, count(*) as sentences, count(*) filter (status in ('approved', 'uncertain', 'skipped')) as reviewed, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'skipped') as skipped from s group by 1)
select p.id as document_id, filename, p.status, epoch_us(created_at) as created_us, coalesce(sentences, 0)::bigint as sentences, coalesce(reviewed, 0)::bigint as reviewed, coalesce(approved, 0)::bigint as approved, coalesce(skipped, 0)::bigint as skipped,
  case when coalesce(sentences, 0) = 0 then 0 else floor(reviewed * 100.0 / sentences + 0.5) end::bigint as percent_done,
  case when p.status = 'reviewable' and coalesce(reviewed, 0) > 0 then 'annotating' else p.status end as shown_status
from p left join t on t.document_id = p.id""",
    )
)
def document_progress(spark, sf_dir):
    """PRJ1, AG1, AG17: papers with their review counts and share."""
    p = C.papers(spark, sf_dir).select(F.col("id").alias("document_id"), "filename", "status", "created_at")
    out = p.join(graph.review_stats(C.sentences(spark, sf_dir), ["document_id"]), "document_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("sentences", "reviewed", "approved", "skipped")]
    done = F.when(F.coalesce("sentences", F.lit(0)) == 0, 0).otherwise(F.floor(F.col("reviewed") * 100.0 / F.col("sentences") + 0.5)).cast("bigint")
    shown = F.when((F.col("status") == "reviewable") & (F.coalesce("reviewed", F.lit(0)) > 0), "annotating").otherwise(F.col("status"))
    return out.select("document_id", "filename", "status", F.unix_micros("created_at").alias("created_us"), *counts, done.alias("percent_done"), shown.alias("shown_status"))


@query(with_sql("s", "select layer, count(*) as sentences, count(*) filter (status in ('approved', 'uncertain', 'skipped')) as reviewed, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'skipped') as skipped from s group by 1"))
def review_stats(spark, sf_dir):
    """AG1: review counts by how the text was obtained."""
    return graph.review_stats(C.sentences(spark, sf_dir), ["layer"])


@query(
    with_sql(
        "s m r",
        f"""a as (select sentence_id, count(*) as n, string_agg(text || ' [' || entity_type || ']', '; ' order by start_offset, end_offset, id) as entities from m group by 1),
b as (select sentence_id, count(*) as n, string_agg(relation_type, '; ' order by relation_type, id) as relations from r group by 1)
select s.id as sentence_id, s.document_id, s.ordinal, coalesce(a.n, 0)::bigint as mention_count, a.entities, case when a.n is not null then coalesce(b.n, 0) else 0 end::bigint as relation_count, case when a.n is not null then b.relations end as relations
from s left join a on a.sentence_id = s.id left join b on b.sentence_id = s.id""",
    )
)
def sentence_detail(spark, sf_dir):
    """PRJ3: sentences with their mentions and relations; relations show only beside mentions."""
    part = F.concat("text", F.lit(" ["), "entity_type", F.lit("]"))
    a = C.mentions(spark, sf_dir).groupBy("sentence_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "id", part.alias("t")))).alias("e"))
    b = C.relations(spark, sf_dir).groupBy("sentence_id").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("relation_type", "id"))).alias("r"))
    s = C.sentences(spark, sf_dir).select(F.col("id").alias("sentence_id"), "document_id", "ordinal")
    out = s.join(a, "sentence_id", "left").join(b, "sentence_id", "left")
    return out.select(
        "sentence_id", "document_id", "ordinal", F.coalesce("n", F.lit(0)).alias("mention_count"), F.array_join(F.transform("e", lambda x: x["t"]), "; ").alias("entities"),
        F.when(F.col("n").isNotNull(), F.coalesce("k", F.lit(0))).otherwise(0).alias("relation_count"),
        F.when(F.col("n").isNotNull(), F.array_join(F.transform("r", lambda x: x["relation_type"]), "; ")).alias("relations"),
    )


@query(with_sql("s", "select document_id, coalesce(min(ordinal) filter (status not in ('approved', 'uncertain', 'skipped')), 0)::int as ordinal from s group by 1"))
def earliest_open(spark, sf_dir):
    """FLT8: where to go on reviewing."""
    return annotate.earliest_open(C.sentences(spark, sf_dir))


@query(with_sql("s", "select document_id, count(*) filter (status not in ('approved', 'uncertain', 'skipped')) = 0 as is_completed from s group by 1"))
def completed_documents(spark, sf_dir):
    """DML1: papers with no sentence left unreviewed."""
    return annotate.completed_documents(C.sentences(spark, sf_dir))


@query(
    with_sql(
        "c e",
        f"""select c.id, l.preferred_name as left_name, r.preferred_name as right_name, array_to_string({_ALIASES.format("l.aliases_json")}, ' | ') as left_aliases, array_to_string({_ALIASES.format("r.aliases_json")}, ' | ') as right_aliases, total_score
from c join e l on l.id = c.left_entity_id join e r on r.id = c.right_entity_id where c.status in ('pending', 'deferred')""",
    )
)
def merge_queue(spark, sf_dir):
    """PRJ4, JN7, SRT5: open merge candidates with both entities."""
    q = resolve.queue(C.candidates(spark, sf_dir), C.entities(spark, sf_dir))
    return q.select("id", F.col("left_preferred_name").alias("left_name"), F.col("right_preferred_name").alias("right_name"), F.array_join("left_aliases", " | ").alias("left_aliases"), F.array_join("right_aliases", " | ").alias("right_aliases"), "total_score")


@query(with_sql("c", "select status, count(*) as n, round(avg(total_score), 6) as mean_score from c group by 1"))
def candidate_summary(spark, sf_dir):
    """AG15: merge candidates by status."""
    return C.candidates(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("total_score"), 6).alias("mean_score"))


# Mentions, spans and graphs -------------------------------------------------------------------------


@query(with_sql("s m", f"select m.id, m.sentence_id, {_EVIDENCE} as evidence from m join s on s.id = m.sentence_id"))
def evidence_text(spark, sf_dir):
    """FLT5: the text each mention was found in."""
    return C.mention_evidence(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir)).select("id", "sentence_id", "evidence")


@query(
    with_sql(
        "s m",
        """select m.id, m.sentence_id, coalesce(m.start_offset >= 0 and m.end_offset > m.start_offset and substring(case coalesce(m.context_role, 'current') when 'previous' then s.context_before when 'next' then s.context_after when 'current' then s.text end, m.start_offset + 1, m.end_offset - m.start_offset) = m.text, false) as is_valid
from m join s on s.id = m.sentence_id""",
    )
)
def span_checks(spark, sf_dir):
    """FLT9: whether a mention's place holds its text."""
    return annotate.span_checks(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))


@query(
    with_sql(
        "s m e",
        f"""a as (select {_NODE} as node_id, m.*, s.document_id, s.ordinal from m join s on s.id = m.sentence_id where s.status = 'approved'),
g as (select node_id, arg_min(text, (document_id, ordinal, start_offset, id)) as first_text, arg_min(entity_type, (document_id, ordinal, start_offset, id)) as first_type, list(distinct text) as texts, count(*) as mention_count, count(distinct document_id) as document_count from a group by 1)
select node_id, coalesce(e.preferred_name, first_text) as name, coalesce(e.entity_type, first_type) as entity_type,
  array_to_string({_BY_LENGTH.format("list_filter(list_concat(list_concat(texts, " + _ALIASES.format("e.aliases_json") + "), [e.preferred_name]), lambda x: x is not null)")}, ' | ') as aliases, mention_count, document_count
from g left join e on e.id = g.node_id""",
    )
)
def global_graph_nodes(spark, sf_dir):
    """AG4, GR2, JN1, JN6: nodes of the graph over all papers."""
    n = graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir))
    return n.withColumn("aliases", F.array_join("aliases", " | "))


_EDGES = f"""n as (select m.id as mention_id, {_NODE} as node_id from m join s on s.id = m.sentence_id where s.status = 'approved'),
ed as (select a.node_id as source_id, r.relation_type, b.node_id as target_id, count(*) as evidence_count, count(distinct s.document_id) as document_count
  from r join s on s.id = r.sentence_id and s.status = 'approved' join n a on a.mention_id = r.source_mention_id join n b on b.mention_id = r.target_mention_id group by 1, 2, 3)"""


def _edges(spark, sf_dir):
    return graph.global_edges(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.relations(spark, sf_dir))


@query(with_sql("s m r", f"{_EDGES} select * from ed"))
def global_graph_edges(spark, sf_dir):
    """AG5, JN5: edges of the graph over all papers."""
    return _edges(spark, sf_dir)


@query(
    with_sql(
        "p s m r",
        f"""{_EDGES}
select (select count(*) from p) as documents, (select count(*) from s) as sentences, (select count(*) from s where status in ('approved', 'uncertain', 'skipped')) as reviewed, (select count(*) from s where status = 'approved') as approved, (select count(*) from s where status = 'skipped') as skipped,
  (select count(distinct node_id) from n) as nodes, (select count(*) from ed) as edges""",
    )
)
def global_graph_stats(spark, sf_dir):
    """AG1, GR2: the sizes of the graph and of what it was made from, one value each."""
    s, m = C.sentences(spark, sf_dir), C.mentions(spark, sf_dir)
    one = F.lit(1).alias("k")
    stats = graph.review_stats(s.withColumn("k", F.lit(1)), ["k"])
    n = m.join(s.where("status = 'approved'").select(F.col("id").alias("sentence_id")), "sentence_id", "left_semi")
    nodes = n.agg(F.countDistinct(F.coalesce(F.nullif("canonical_entity_id", F.lit("")), "id")).alias("nodes")).select(one, "nodes")
    edges = _edges(spark, sf_dir).agg(F.count("*").alias("edges")).select(one, "edges")
    docs = C.papers(spark, sf_dir).agg(F.count("*").alias("documents")).select(one, "documents")
    return docs.join(stats, "k", "left").join(nodes, "k").join(edges, "k").select("documents", "sentences", "reviewed", "approved", "skipped", "nodes", "edges")


@query(with_sql("s m r", f"""{_EDGES} select distinct x as node_id, y as neighbour_id from (select source_id as x, target_id as y from ed union all select target_id, source_id from ed) where x <> y"""))
def neighbours(spark, sf_dir):
    """JN13, GR4: nodes one edge apart."""
    return graph.neighbours(_edges(spark, sf_dir))


@query(with_sql("s m r", f"""{_EDGES} select x as node_id, count(distinct y) as neighbour_count from (select source_id as x, target_id as y from ed union all select target_id, source_id from ed) where x <> y group by 1"""))
def neighbour_counts(spark, sf_dir):
    """AG17: how many nodes stand next to each."""
    return graph.neighbours(_edges(spark, sf_dir)).groupBy("node_id").agg(F.count("*").alias("neighbour_count"))


@query(with_sql("s m r", f"""{_EDGES} select r.id as relation_id, a.node_id as source_id, r.relation_type, b.node_id as target_id, s.document_id, s.id as sentence_id, s.page_number, s.text as evidence
  from r join s on s.id = r.sentence_id and s.status = 'approved' join n a on a.mention_id = r.source_mention_id join n b on b.mention_id = r.target_mention_id"""))
def edge_evidence(spark, sf_dir):
    """AG8: the sentence each relation of the graph stands in."""
    return graph.edge_evidence(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.relations(spark, sf_dir))


@query(
    with_sql(
        "s m",
        """x as (select m.*, coalesce(case coalesce(m.context_role, 'current') when 'previous' then s.context_before when 'next' then s.context_after when 'current' then s.text end, '') as src from m join s on s.id = m.sentence_id),
y as (select *, coalesce(start_offset >= 0 and end_offset > start_offset and substring(src, start_offset + 1, end_offset - start_offset) = text, false) as fits from x),
z as (select *, case when fits then [start_offset::bigint] when length(text) > 0 then list_filter(range(0, length(src) - length(text) + 1), lambda i: substring(src, (i + 1)::bigint, length(text)) = text) else [] end as spots from y)
select id, sentence_id, len(spots)::int as occurrences, case when len(spots) = 1 then spots[1] end::int as "start", case when fits then end_offset when len(spots) = 1 then spots[1] + length(text) end::int as "end" from z""",
    )
)
def repaired_spans(spark, sf_dir):
    """FN24: wrong places of mentions mended where their text stands once, overlapping occurrences counted."""
    return annotate.repaired_spans(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))


@query(with_sql("s m", f"select {_NODE} as node_id, m.id as mention_id, s.document_id, s.id as sentence_id, s.page_number, m.text as mention_text, m.context_role, {_EVIDENCE} as evidence from m join s on s.id = m.sentence_id where s.status = 'approved'"))
def node_evidence(spark, sf_dir):
    """AG8: the mentions behind each node of the global graph with their texts."""
    return graph.node_evidence(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))


@query(with_sql("c", """select count(*) filter (status = 'auto_merged') as auto_merged, count(*) filter (status = 'pending') as candidates, count(*) as pairs_scored from c where total_score >= 0.85"""))
def resolution_summary(spark, sf_dir):
    """AG15: a run's candidates counted by what became of them."""
    return resolve.run_summary(C.candidates(spark, sf_dir).where("total_score >= 0.85"))


@query(with_sql("s m e", f"""g as (select {_NODE} as node_id, count(*) as mention_count from m join s on s.id = m.sentence_id where s.status = 'approved' group by 1)
select node_id, mention_count from g order by mention_count desc, node_id limit 160"""))
def top_nodes(spark, sf_dir):
    """LIM2: the 160 nodes with the most mentions."""
    n = graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir))
    return graph.top_nodes(n).select("node_id", "mention_count")


@query(with_sql("s m e", f"""g as (select {_NODE} as node_id, arg_min(m.text, (s.document_id, s.ordinal, m.start_offset, m.id)) as first_text, arg_min(m.entity_type, (s.document_id, s.ordinal, m.start_offset, m.id)) as first_type from m join s on s.id = m.sentence_id where s.status = 'approved' group by 1)
select node_id, coalesce(e.preferred_name, first_text) as name, coalesce(e.entity_type, first_type) as entity_type from g left join e on e.id = node_id
where contains(lower(coalesce(e.preferred_name, first_text)), 'glass') or contains(lower(coalesce(e.entity_type, first_type)), 'glass')"""))
def graph_search(spark, sf_dir):
    """FLT6: nodes found by a piece of their name or type."""
    n = graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir))
    return graph.searched(n, " Glass ").select("node_id", "name", "entity_type")


@query(with_sql("s m e", f"""g as (select {_NODE} as node_id, count(*) as mention_count, arg_min(m.entity_type, (s.document_id, s.ordinal, m.start_offset, m.id)) as first_type from m join s on s.id = m.sentence_id where s.status = 'approved' group by 1)
select coalesce(e.entity_type, first_type) as entity_type, count(*) as nodes, sum(mention_count)::bigint as mentions, round(max(least(15, 7 + 2 * log2(mention_count + 1))), 6) as largest_radius from g left join e on e.id = node_id group by 1"""))
def entity_type_legend(spark, sf_dir):
    """AG18, GR6: the types of the graph with their sizes."""
    n = graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir))
    return n.groupBy("entity_type").agg(F.count("*").alias("nodes"), F.sum("mention_count").alias("mentions"), F.round(F.max(numbers.node_radius(F.col("mention_count"))), 6).alias("largest_radius"))


_ARTICLE = f"""a as (select m.*, s.document_id, s.ordinal, {_GRAPH_KEY.replace("nfkc_or_self", "m.text")} as node_key from m join s on s.id = m.sentence_id where s.status = 'approved'),
f as (select document_id, entity_type, node_key, arg_min(coalesce(nullif(canonical_entity_id, ''), id), (document_id, ordinal, start_offset, id)) as node_id, list(distinct text) as texts, count(*) as mention_count from a group by 1, 2, 3)"""


@query(with_sql("s m", f"""{_ARTICLE} select document_id, node_id, node_key, ({_BY_LENGTH.format("texts")})[1] as name, entity_type, array_to_string({_BY_LENGTH.format("texts")}, ' | ') as aliases, mention_count from f"""))
def article_graph_nodes(spark, sf_dir):
    """AG3, AG6, FN1: nodes of each paper's own graph."""
    n = graph.article_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))
    return n.withColumn("aliases", F.array_join("aliases", " | "))


@query(with_sql("s m r", f"""{_ARTICLE}, n as (select a.id as mention_id, f.node_id from a join f using (document_id, entity_type, node_key))
select s.document_id, x.node_id as source_id, r.relation_type, y.node_id as target_id, count(*) as evidence_count from r join s on s.id = r.sentence_id and s.status = 'approved' join n x on x.mention_id = r.source_mention_id join n y on y.mention_id = r.target_mention_id group by 1, 2, 3, 4"""))
def article_graph_edges(spark, sf_dir):
    """AG5, GR1: edges of each paper's own graph."""
    return graph.article_edges(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.relations(spark, sf_dir))


@query(
    with_sql(
        "m",
        """sp as (select *, row_number() over (partition by sentence_id order by a, b) as n from (select distinct sentence_id, start_offset as a, end_offset as b from m where coalesce(context_role, 'current') = 'current' and end_offset > start_offset and start_offset >= 0)),
k as (select sentence_id, n, a, b, true as kept, b as last from sp where n = 1
  union all
  select sp.sentence_id, sp.n, sp.a, sp.b, sp.a >= k.last, case when sp.a >= k.last then sp.b else k.last end from k join sp on sp.sentence_id is not distinct from k.sentence_id and sp.n = k.n + 1)
select sentence_id, a as "start", b as "end" from k where kept""",
    ).replace("with ", "with recursive ", 1)
)
def highlighted_spans(spark, sf_dir):
    """WN14: non-overlapping spans to mark in each sentence (tested against a sequential model)."""
    h = annotate.highlighted(C.mentions(spark, sf_dir))
    return h.select("sentence_id", F.explode("spans").alias("s")).select("sentence_id", "s.start", "s.end")


@query(
    with_sql(
        "m r",
        """t as (select distinct name from (select entity_type as name from m union all select relation_type from r) where name is not null),
h as (select name, list_reduce(list_transform(string_split(name, ''), lambda x: unicode(x)::bigint), lambda a, x: (a * 31 + x) & 4294967295) as h from t)
select name, array_to_string(list_transform(string_split(lower(name), '_'), lambda x: upper(x[1:1]) || x[2:]), ' ') as label,
  (abs(case when h >= 2147483648 then h - 4294967296 else h end) % 8)::int as color, case when length(name) > 24 then substring(name, 1, 22) || '…' else name end as short from h""",
    )
)
def type_labels(spark, sf_dir):
    """FN25, FN27, FN28: labels and colours of the types in use."""
    m, r = C.mentions(spark, sf_dir), C.relations(spark, sf_dir)
    t = m.select(F.col("entity_type").alias("name")).unionByName(r.select(F.col("relation_type").alias("name"))).where("name is not null").distinct()
    return t.select("name", X.humanized(F.col("name")).alias("label"), X.color_slot(F.col("name")).alias("color"), X.shortened(F.col("name")).alias("short"))


# Exports --------------------------------------------------------------------------------------------


@query(with_sql("s m r", """select s.document_id, s.id as sentence_id, s.page_number as page, a.text as subject, r.relation_type as relation, b.text as object, s.text as evidence
from r join s on s.id = r.sentence_id join m a on a.id = r.source_mention_id join m b on b.id = r.target_mention_id"""))
def triples_export(spark, sf_dir):
    """SNK2, JN3: relations as triples."""
    return sinks.triples(C.sentences(spark, sf_dir), C.mentions(spark, sf_dir), C.relations(spark, sf_dir))


@query(
    with_sql(
        "s m r",
        """a as (select sentence_id, list({'id': id, 'text': text, 'entity_type': entity_type, 'start': start_offset, 'end': end_offset, 'context_role': context_role, 'source': source, 'decision': decision, 'canonical_entity_id': canonical_entity_id} order by id) as entities from m group by 1),
b as (select sentence_id, list({'id': id, 'source_mention_id': source_mention_id, 'target_mention_id': target_mention_id, 'relation_type': relation_type, 'source': source} order by id) as relations from r group by 1)
select document_id, ordinal, to_json({'sentence_id': s.id, 'document_id': document_id, 'ordinal': ordinal, 'page_number': page_number, 'text': s.text, 'status': s.status, 'entities': coalesce(a.entities, []), 'relations': coalesce(b.relations, [])})::varchar as line
from s left join a on a.sentence_id = s.id left join b on b.sentence_id = s.id""",
    )
)
def sentence_jsonl(spark, sf_dir):
    """SNK1: sentences as JSON lines."""
    return sinks.sentence_lines(C.sentences(spark, sf_dir), C.mentions(spark, sf_dir), C.relations(spark, sf_dir))


@query(SQL["global_graph_nodes"].replace("select node_id, coalesce", ", gn as (select node_id, coalesce", 1) + f""")
select node_id, {_GEXF_NODE} as xml from gn""")
def gexf_nodes(spark, sf_dir):
    """SNK3: node elements of the exported graph."""
    return sinks.gexf_nodes(graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir)))


@query(with_sql("s m r", f"""{_EDGES}, k as (select *, row_number() over (order by source_id, relation_type, target_id) - 1 as edge_no from ed)
select edge_no, {_GEXF_EDGE} as xml from k"""))
def gexf_edges(spark, sf_dir):
    """SNK3: edge elements of the exported graph."""
    return sinks.gexf_edges(_edges(spark, sf_dir))


@query(
    f"""with recursive {_GATED}, {_merged_sql("gb")},
x as (select document_id, to_json(list({{'page_number': page_number, 'category': category, 'content': text, 'bbox': bbox}} order by block_no))::varchar as label_structure from gb group by 1),
y as (select document_id, to_json(list({{'page_number': page_number, 'category': category, 'content': text, 'bbox': bbox}} order by block_no))::varchar as label_structure_cleaned from mb group by 1)
select document_id, label_structure, label_structure_cleaned from x left join y using (document_id)"""
)
def block_artifacts(spark, sf_dir):
    """SNK5: the gated blocks of each digital paper, before and after fragments are joined, as JSON lists."""
    kept = blocks.gated(_parsed(spark, sf_dir))
    return sinks.block_artifacts(kept, blocks.merged(kept))


# Revisions and agreement ----------------------------------------------------------------------------


def revisions(spark, sf_dir, raters: int = 3):
    """Three raters' revisions of reviewed sentences, the type shifted where (ordinal + rater) % 5 = 0."""
    # without the texts, which repeated rows share
    s = table(spark, sf_dir, "sentences").select("id", "document_id", "ordinal", "status").distinct()
    m, r = C.mentions(spark, sf_dir), C.relations(spark, sf_dir)
    first = annotate.backfill(s, m, r).join(s.select(F.col("id").alias("sentence_id"), "document_id", "ordinal"), "sentence_id")
    rater = F.explode(F.sequence(F.lit(1), F.lit(raters)))
    rows = first.drop("revision_number").withColumn("revision_number", rater)
    shift = (F.col("ordinal") + F.col("revision_number")) % 5 == 0
    moved = F.transform("entities", lambda e: e.withField("entity_type", F.when(shift, F.concat(e["entity_type"], F.lit("2"))).otherwise(e["entity_type"])))
    return rows.withColumn("entities", moved)


@query(
    with_sql(
        "s m r",
        """t as (select id as sentence_id, status from s where status in ('approved', 'uncertain', 'skipped')),
e as (select m.id, m.sentence_id from m join t using (sentence_id) where t.status <> 'skipped'),
l as (select r.sentence_id, r.id from r join e a on a.id = r.source_mention_id and a.sentence_id = r.sentence_id join e b on b.id = r.target_mention_id and b.sentence_id = r.sentence_id)
select sentence_id, 1 as revision_number, status, (select count(*) from e where e.sentence_id = t.sentence_id) as entities, (select count(*) from l where l.sentence_id = t.sentence_id) as relations from t""",
    )
)
def backfill_revisions(spark, sf_dir):
    """DML2, DML3: first revisions of reviewed sentences."""
    b = annotate.backfill(C.sentences(spark, sf_dir), C.mentions(spark, sf_dir), C.relations(spark, sf_dir))
    return b.select("sentence_id", "revision_number", "status", F.size("entities").cast("bigint").alias("entities"), F.size("relations").cast("bigint").alias("relations"))


def saves(spark, sf_dir):
    """Saves of every tenth sentence: its mentions that stand at their places, with their relations; each second is a skip."""
    s = C.sentences(spark, sf_dir).where("ordinal % 10 = 3").withColumn("status", F.when(F.col("ordinal") % 20 == 13, "skipped").otherwise("approved"))
    m = C.mentions(spark, sf_dir)
    fits = annotate.span_checks(m, C.sentences(spark, sf_dir)).where("is_valid").select("id")
    state = annotate.backfill(s, m.join(fits, "id", "left_semi"), C.relations(spark, sf_dir))
    return state.drop("revision_number").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))


@query(
    with_sql(
        "p s m r",
        """x as (select id as sentence_id, document_id, case when ordinal % 20 = 13 then 'skipped' else 'approved' end as status from s where ordinal % 10 = 3),
v as (select m.*, x.sentence_id || '-1-' || m.id as new_id from m join x using (sentence_id) join s on s.id = m.sentence_id where x.status <> 'skipped'
  and m.start_offset >= 0 and m.end_offset > m.start_offset and substring(case coalesce(m.context_role, 'current') when 'previous' then s.context_before when 'next' then s.context_after when 'current' then s.text end, m.start_offset + 1, m.end_offset - m.start_offset) = m.text),
k as (select * from m where sentence_id is null or sentence_id not in (select sentence_id from x)),
l as (select r.*, a.new_id as a, b.new_id as b, row_number() over (partition by r.sentence_id order by r.source_mention_id, r.target_mention_id, r.relation_type, r.source) - 1 as nth from r join v a on a.id = r.source_mention_id and a.sentence_id = r.sentence_id join v b on b.id = r.target_mention_id and b.sentence_id = r.sentence_id),
g as (select canonical_entity_id as id from m where sentence_id in (select sentence_id from x) and canonical_entity_id is not null and canonical_entity_id not in (select canonical_entity_id from k where canonical_entity_id is not null)),
n as (select s.id, s.document_id, coalesce(x.status, s.status) as status from s left join x on x.sentence_id = s.id),
o as (select document_id from n where document_id in (select document_id from x) group by 1 having count(*) filter (status not in ('approved', 'uncertain', 'skipped')) = 0)
select 'sentence' as kind, id, status as value from n
union all select 'mention', id, canonical_entity_id from k union all select 'mention', new_id, 'c-' || new_id from v
union all select 'relation', id, source_mention_id || ' ' || target_mention_id from r where sentence_id is null or sentence_id not in (select sentence_id from x)
union all select 'relation', sentence_id || '-1-r' || nth, a || ' ' || b from l
union all select 'entity', id, preferred_name from canonical_entities where id not in (select id from g) union all select 'entity', 'c-' || new_id, text from v
union all select 'paper', id, case when id in (select document_id from o) then 'completed' else status end from p
union all select 'revision', sentence_id, '1 ' || status from x""",
    )
)
def saved_annotations(spark, sf_dir):
    """DML1: all tables after the saves, as (kind, id, value)."""
    tables = {
        "papers": C.papers(spark, sf_dir), "sentences": C.sentences(spark, sf_dir), "mentions": C.mentions(spark, sf_dir),
        "relations": C.relations(spark, sf_dir), "entities": table(spark, sf_dir, "canonical_entities"),
    }
    after = annotate.save_annotations(tables, saves(spark, sf_dir))
    shown = {
        "sentence": ("sentences", "id", F.col("status")), "mention": ("mentions", "id", F.col("canonical_entity_id")), "entity": ("entities", "id", F.col("preferred_name")),
        "relation": ("relations", "id", F.concat("source_mention_id", F.lit(" "), "target_mention_id")), "paper": ("papers", "id", F.col("status")),
        "revision": ("revisions", "sentence_id", F.concat_ws(" ", "revision_number", "status")),
    }
    out = None
    for kind, (name, key, value) in shown.items():
        rows = after[name].select(F.lit(kind).alias("kind"), F.col(key).alias("id"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n, count(*) over (partition by user_id) as saves from events) where n <= 2 and saves >= 2")
def latest_two(spark, sf_dir):
    """WN4: the last two events of each user that has so many, events standing for saves."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    saves = table(spark, sf_dir, "events").select(F.col("user_id").alias("sentence_id"), at.alias("revision_number"), "event_id", "event_type")
    return agreement.latest_revisions(saves, 2).select(F.col("sentence_id").alias("user_id"), "event_id", "event_type")


@query("select user_id, count(*) + 1 as next_number from events group by 1")
def next_revision(spark, sf_dir):
    """AG2, WN5: the number after the last, events standing for saves."""
    numbered = table(spark, sf_dir, "events").select(F.col("user_id").alias("sentence_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("revision_number"))
    return annotate.next_numbers(numbered).select(F.col("sentence_id").alias("user_id"), "next_number")


_KAPPA = "case when kappa is null then '无法计算' when kappa < 0 then '低于随机一致' when kappa < 0.2 then '轻微一致' when kappa < 0.4 then '一般一致' when kappa < 0.6 then '中等一致' when kappa < 0.8 then '较强一致' else '高度一致' end"
_RATED = """t as (select id as sentence_id, ordinal, document_id from s where status in ('approved', 'uncertain')),
i as (select m.sentence_id, t.document_id, t.ordinal, g.r, concat_ws('|', coalesce(m.context_role, 'current'), m.start_offset, m.end_offset, m.text) as item, m.id,
  m.entity_type || case when (t.ordinal + g.r) % 5 = 0 then '2' else '' end as category from m join t using (sentence_id), (select unnest([1, 2, 3]) as r) g),
k as (select document_id, sentence_id, r, item, arg_max(category, (id)) as category from i group by 1, 2, 3, 4),
v as (select document_id, sentence_id || '/' || item as item, category, count(*) as votes from k group by 1, 2, 3),
pi as (select document_id, item, (sum(votes * votes) - 3) / 6.0 as p from v group by 1, 2),
po as (select document_id, count(*) as items, avg(p) as po from pi group by 1),
pc as (select document_id, category, sum(votes) as c from v group by 1, 2),
pe as (select document_id, sum(c * c)::double / (sum(c) * sum(c))::double as pe from pc group by 1)"""


@query(with_sql("s m", f"""{_RATED} select document_id, items, round(po, 6) as observed, round(pe, 6) as expected, case when abs(1 - pe) >= 1e-12 then round((po - pe) / (1 - pe), 6) end as kappa from po join pe using (document_id)"""))
def fleiss_revisions(spark, sf_dir):
    """AG9, AG11, SET1: agreement of three raters on entity types, per paper."""
    rev = revisions(spark, sf_dir).where("status <> 'skipped'")
    papers = rev.select("sentence_id", "document_id").distinct()
    votes = agreement.votes_of(agreement.entity_ratings(rev), rev).join(papers, "sentence_id")
    return agreement.fleiss(votes.withColumn("item", F.concat_ws("/", "sentence_id", "item")), ["document_id"], 3)


@query(
    with_sql(
        "s m r",
        f"""places(n, place) as (values {", ".join(f"({n}, {p})" for n in range(51, 161) for p in agreement.sample_places(n, 50, 42))}),
t as (select distinct id as sentence_id, document_id, ordinal, status from s where status in ('approved', 'uncertain', 'skipped')),
el as (select *, row_number() over (partition by document_id order by ordinal, sentence_id) - 1 as place, count(*) over (partition by document_id) as n from t),
sa as (select * from el where n <= 50 or (n, place) in (select n, place from places)),
e as (select sa.document_id, sa.sentence_id, sa.ordinal, m.id, concat_ws('|', coalesce(m.context_role, 'current'), m.start_offset, m.end_offset, m.text) as item, m.entity_type from m join sa using (sentence_id) where sa.status <> 'skipped'),
x as (select document_id, 'entity' as scope, sentence_id || '/' || item as item, g.r, arg_max(entity_type || case when (ordinal + g.r) % 5 = 0 then '2' else '' end, id) as category from e, (select unnest([2, 3]) as r) g group by 1, 2, 3, 4
  union all
  select a.document_id, 'relation', a.sentence_id || '/' || a.item || ' -> ' || b.item, g.r, arg_max(r.relation_type, (r.source_mention_id, r.target_mention_id, r.relation_type, r.source))
  from r join e a on a.id = r.source_mention_id and a.sentence_id = r.sentence_id join e b on b.id = r.target_mention_id and b.sentence_id = r.sentence_id, (select unnest([2, 3]) as r) g group by 1, 2, 3, 4),
y as (select * from x union all select document_id, 'overall', scope || ' ' || item, r, category from x),
v as (select document_id, scope, item, category, count(*) as votes from y group by 1, 2, 3, 4),
po as (select document_id, scope, count(*) as items, avg(p) as po from (select document_id, scope, item, (sum(votes * votes) - 2) / 2.0 as p from v group by 1, 2, 3) group by 1, 2),
pe as (select document_id, scope, sum(c * c)::double / (sum(c) * sum(c))::double as pe from (select document_id, scope, category, sum(votes) as c from v group by 1, 2, 3) group by 1, 2),
z as (select document_id, scope, items, round(po, 6) as observed, round(pe, 6) as expected, case when abs(1 - pe) >= 1e-12 then round((po - pe) / (1 - pe), 6) end as kappa from po join pe using (document_id, scope))
select *, {_KAPPA} as label from z""",
    )
)
def agreement_report(spark, sf_dir):
    """AG12, SMP1, SET2, SRT4: the sampled agreement of each paper, for entities, relations and both."""
    return agreement.agreement_report(revisions(spark, sf_dir), raters=2)


@query()
def kappa_labels(spark, sf_dir):
    """AG13: a word for each paper's agreement."""
    return fleiss_revisions(spark, sf_dir).select("document_id", "kappa", numbers.kappa_label(F.col("kappa")).alias("label"))


SQL["kappa_labels"] = with_sql("s m", f"""{_RATED}, z as (select document_id, case when abs(1 - pe) >= 1e-12 then round((po - pe) / (1 - pe), 6) end as kappa from po join pe using (document_id))
select document_id, kappa, case when kappa is null then '无法计算' when kappa < 0 then '低于随机一致' when kappa < 0.2 then '轻微一致' when kappa < 0.4 then '一般一致' when kappa < 0.6 then '中等一致' when kappa < 0.8 then '较强一致' else '高度一致' end as label from z""")


# Resolution -----------------------------------------------------------------------------------------


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings)
select a.vec_id as left_id, b.vec_id as right_id, round(list_cosine_similarity(a.e, b.e), 6) as score from v a join v b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.3""")
def cosine_pairs(spark, sf_dir):
    """FN30, JN8: similar vectors of one label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    found = resolve.dense_pairs(v, "label", 0.3)
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query(with_sql("c", """select id, case when total_score >= 0.99 then 'auto_merge' when total_score >= 0.85 then 'candidate' else 'ignore' end as action, printf('%.2f%%', total_score * 100) as shown from c"""))
def similarity_policy(spark, sf_dir):
    """FN32, FN37: what a candidate's score asks for."""
    return C.candidates(spark, sf_dir).select("id", numbers.similarity_class(F.col("total_score")).alias("action"), numbers.percent(F.col("total_score")).alias("shown"))


@query(with_sql("c", """x as (select distinct least(left_entity_id, right_entity_id) as a, greatest(left_entity_id, right_entity_id) as b from c where status = 'rejected' and left_entity_id is not null and right_entity_id is not null)
select id from c where status <> 'rejected' and not exists (select 1 from x where x.a = least(left_entity_id, right_entity_id) and x.b = greatest(left_entity_id, right_entity_id) and left_entity_id is not null and right_entity_id is not null)"""))
def rejected_antijoin(spark, sf_dir):
    """JN9: candidates whose pair was never rejected, in either order."""
    c = C.candidates(spark, sf_dir)
    whole = "left_entity_id is not null and right_entity_id is not null"
    kept = resolve.unrejected(c.where("status <> 'rejected'").where(whole), c.where("status = 'rejected'").where(whole)).select("id")
    return kept.unionByName(c.where("status <> 'rejected'").where(f"not ({whole})").select("id"))


@query(with_sql("", """select id, min(id) over (partition by entity_type, preferred_name) as survivor_id from canonical_entities where active and preferred_name is not null and entity_type is not null qualify id <> min(id) over (partition by entity_type, preferred_name)""").replace("with \n", ""))
def auto_merge_map(spark, sf_dir):
    """DML4, GR7: entities folded into the first of the same type and name."""
    return resolve.auto_merges(table(spark, sf_dir, "canonical_entities"))


@query(with_sql("e", f"""select id, array_to_string({_BY_LENGTH.format("list_concat([preferred_name], " + _ALIASES.format("aliases_json") + ")")}, ' | ') as names from e where preferred_name is not null"""))
def alias_lists(spark, sf_dir):
    """AG6, SET3, SRT7: all names of an entity, shortest first."""
    e = C.entities(spark, sf_dir).where("preferred_name is not null")
    return e.select("id", F.array_join(names.by_length(F.concat(F.array("preferred_name"), names.aliases_of(F.col("aliases_json")))), " | ").alias("names"))


@query()
def local_hash_embedding(spark, sf_dir):
    """FN33: hashed trigram vectors of the distinct entity names, sparse."""
    n = C.entities(spark, sf_dir).where("preferred_name is not null").select(F.col("preferred_name").alias("text"), F.col("preferred_name").alias("name")).distinct()
    return embed.sparse_vectors(n).select("name", "bucket", F.round("weight", 6).alias("weight"))


@query()
def entity_candidates(spark, sf_dir):
    """DML4, JN4, LIM1, AG14, FN31: scored pairs of canonical entities, contexts included."""
    e = table(spark, sf_dir, "canonical_entities")
    context = resolve.contexts(e, C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))
    rejected = C.candidates(spark, sf_dir).where("status = 'rejected' and left_entity_id is not null and right_entity_id is not null")
    pairs = resolve.scored_pairs(e, context, rejected)
    scores = [F.round(c, 6).alias(c) for c in ("name_score", "context_score", "total_score")]
    return resolve.kept_candidates(pairs, resolve.auto_merges_with_rejected(e, rejected)).select("left_entity_id", "right_entity_id", "entity_type", *scores, "action", "is_stale")


@query(with_sql("s m e", """t as (select m.canonical_entity_id as id, s.text, row_number() over (partition by m.canonical_entity_id order by s.document_id, s.ordinal, m.id) as n from m join s on s.id = m.sentence_id where m.canonical_entity_id is not null)
select e.id, coalesce(nullif((select string_agg(text, ' ' order by n) from t where t.id = e.id and n <= 5), ''), e.preferred_name) as context from e"""))
def entity_contexts(spark, sf_dir):
    """JN4, LIM1, AG14: up to five sentences around each entity."""
    return resolve.contexts(C.entities(spark, sf_dir), C.mentions(spark, sf_dir), C.sentences(spark, sf_dir))


def _merges(spark, sf_dir):
    c = C.candidates(spark, sf_dir).where("status = 'merged' and left_entity_id is not null and right_entity_id is not null and left_entity_id <> right_entity_id")
    return c.groupBy(F.greatest("left_entity_id", "right_entity_id").alias("id")).agg(F.min(F.least("left_entity_id", "right_entity_id")).alias("survivor_id"))


@query(with_sql("m c", """g as (select greatest(left_entity_id, right_entity_id) as id, min(least(left_entity_id, right_entity_id)) as survivor_id from c where status = 'merged' and left_entity_id is not null and right_entity_id is not null and left_entity_id <> right_entity_id group by 1),
w as (select id, survivor_id from g union all select w.id, g.survivor_id from w join g on g.id = w.survivor_id),
f as (select id, survivor_id from w where survivor_id not in (select id from g))
select coalesce(f.survivor_id, m.canonical_entity_id) as canonical_entity_id, count(*) as mentions from m left join f on f.id = m.canonical_entity_id group by 1""").replace("with ", "with recursive ", 1))
def repointed_mentions(spark, sf_dir):
    """DML5: mentions per entity once merged entities point to their survivors."""
    m = resolve.repointed(C.mentions(spark, sf_dir), _merges(spark, sf_dir))
    return m.groupBy("canonical_entity_id").agg(F.count("*").alias("mentions"))


@query(
    with_sql(
        "c",
        f"""g as (select greatest(left_entity_id, right_entity_id) as id, min(least(left_entity_id, right_entity_id)) as survivor_id from c where status = 'merged' and left_entity_id is not null and right_entity_id is not null and left_entity_id <> right_entity_id group by 1),
w as (select id, survivor_id from g union all select w.id, g.survivor_id from w join g on g.id = w.survivor_id),
f as (select id, survivor_id from w where survivor_id not in (select id from g)),
al as (select f.survivor_id as id, list_concat({_ALIASES.format("e.aliases_json")}, [e.preferred_name]) as names from f join canonical_entities e on e.id = f.id
  union all select id, list_concat({_ALIASES.format("aliases_json")}, [preferred_name]) from canonical_entities where id in (select f.survivor_id from f join canonical_entities e on e.id = f.id)),
u as (select id, to_json(list_sort(list_distinct(flatten(list(names)))))::varchar as names from al group by 1)
select e.id, e.preferred_name, e.entity_type, e.description, coalesce(u.names, e.aliases_json) as aliases_json, e.active and e.id not in (select id from f) as active
from canonical_entities e left join u on u.id = e.id""",
    ).replace("with ", "with recursive ", 1)
)
def merged_entities(spark, sf_dir):
    """DML5, SET3: entities after the recorded merges."""
    return resolve.merged_entities(table(spark, sf_dir, "canonical_entities"), _merges(spark, sf_dir))


_OPEN = """o as (select c.*, l.preferred_name as ln, r.preferred_name as rn from c join canonical_entities l on l.id = c.left_entity_id join canonical_entities r on r.id = c.right_entity_id where c.status = 'pending' and l.active and r.active and l.id <> r.id),
d as (select id, right_entity_id as gone from o order by total_score desc nulls last, id limit 1)"""


@query(with_sql("c", f"""{_OPEN}
select c.id, case when c.id in (select id from d) then 'merged' when c.id in (select id from o) and c.total_score < 0.5 then 'rejected' when c.id in (select id from o) and c.total_score < 0.7 then 'deferred'
  when c.status = 'pending' and (c.left_entity_id in (select gone from d) or c.right_entity_id in (select gone from d)) then 'superseded' else c.status end as status from c"""))
def decided_candidates(spark, sf_dir):
    """DML6: candidates after the best open one is merged, weak ones rejected and doubtful ones deferred."""
    c, e = C.candidates(spark, sf_dir), table(spark, sf_dir, "canonical_entities")
    active = e.where("active").select("id", "preferred_name")
    o = c.where("status = 'pending' and left_entity_id <> right_entity_id")
    for side in ("left", "right"):
        o = o.join(active.select(F.col("id").alias(f"{side}_entity_id"), F.col("preferred_name").alias(f"{side}_name")), f"{side}_entity_id")
    best = o.orderBy(F.desc_nulls_last("total_score"), "id").limit(1).select("id", F.lit("merge").alias("decision"), F.col("left_name").alias("preferred_name"))
    weak = o.join(best, "id", "left_anti").where("total_score < 0.7")
    rest = weak.select("id", F.when(F.col("total_score") < 0.5, "reject").otherwise("defer").alias("decision"), F.lit(None).cast("string").alias("preferred_name"))
    return resolve.decide(c, best.unionByName(rest), e)[0].select("id", "status")


# Maintenance, suggestions and ontology ---------------------------------------------------------------


@query(with_sql("m", "select id from canonical_entities where id not in (select canonical_entity_id from m where canonical_entity_id is not null)"))
def orphan_canonicals(spark, sf_dir):
    """JN10, AG16, SET4: entities nobody mentions."""
    return maintain.unreferenced(table(spark, sf_dir, "canonical_entities"), C.mentions(spark, sf_dir)).select("id")


@query(
    with_sql(
        "p s m",
        """g as (select min(id) as id from p), d as (select id from s where document_id in (select id from g)), x as (select * from m where sentence_id in (select id from d)), y as (select * from m where sentence_id not in (select id from d)),
o as (select distinct canonical_entity_id as id from x where canonical_entity_id is not null and canonical_entity_id not in (select canonical_entity_id from y where canonical_entity_id is not null))
select 'sentences' as kind, (select count(*) from d) as removed union all select 'mentions', (select count(*) from x) union all select 'entities', (select count(*) from o where id in (select id from canonical_entities))""",
    )
)
def delete_document(spark, sf_dir):
    """DML7, JN11, FLT4: what goes when the first paper is deleted."""
    papers = C.papers(spark, sf_dir)
    tables = {
        "papers": papers, "sentences": C.sentences(spark, sf_dir), "mentions": C.mentions(spark, sf_dir), "relations": C.relations(spark, sf_dir),
        "entities": table(spark, sf_dir, "canonical_entities"), "candidates": C.candidates(spark, sf_dir),
    }
    return maintain.delete_documents(tables, papers.agg(F.min("id").alias("document_id")))[1]


@query(with_sql("p", "select id as document_id, storage_path as path from p where sentence_count = 0 and storage_path <> ''"))
def removable_files(spark, sf_dir):
    """SET5: the files that go when the papers without a sentence are deleted."""
    p = C.papers(spark, sf_dir)
    return maintain.files_of(p, p.where("sentence_count = 0").select(F.col("id").alias("document_id")))


@query("select 'ok' as status")
def health(spark, sf_dir):
    """PRJ6: a session that answers."""
    return spark.range(1).select(F.lit("ok").alias("status"))


def predictions(spark, sf_dir):
    """Current mentions as predictions of their sentence, every third with its place lost."""
    m = C.mentions(spark, sf_dir).where("coalesce(context_role, 'current') = 'current'")
    lost = F.pmod(F.col("start_offset"), F.lit(3)) == 0
    return m.select("sentence_id", F.col("id").alias("local_id"), "text", "entity_type", F.when(lost, 0).otherwise(F.col("start_offset")).alias("start"), F.when(lost, 1).otherwise(F.col("end_offset")).alias("end"))


@query(
    with_sql(
        "s m",
        """x as (select sentence_id, id as local_id, text, entity_type, case when start_offset % 3 = 0 then 0 else start_offset end as a, case when start_offset % 3 = 0 then 1 else end_offset end as b from m where coalesce(context_role, 'current') = 'current'),
y as (select x.*, s.text as st, coalesce(a >= 0 and b > a and substring(s.text, a + 1, b - a) = x.text, false) as fits from x join s on s.id = x.sentence_id where x.entity_type in (select distinct entity_type from seed_entities))
select sentence_id, local_id, text, entity_type, (case when fits then a else strpos(st, text) - 1 end)::int as "start", (case when fits then b else strpos(st, text) - 1 + length(text) end)::int as "end"
from y where fits or (length(text) > 0 and (length(st) - length(replace(st, text, ''))) / length(text) = 1)""",
    )
)
def suggestion_validate(spark, sf_dir):
    """FN23: predicted spans anchored in their sentence, types held against the ontology in use."""
    types = table(spark, sf_dir, "seed_entities").select("entity_type")
    return suggest.valid_entities(predictions(spark, sf_dir), C.sentences(spark, sf_dir), types)


@query(
    with_sql(
        "m r",
        """o as (select r.relation_type, list(distinct a.entity_type) as subj, list(distinct b.entity_type) as obj from r join m a on a.id = r.source_mention_id join m b on b.id = r.target_mention_id where a.entity_type in (select entity_type from seed_entities) and b.entity_type in (select entity_type from seed_entities) group by 1),
p as (select distinct a.entity_type as source_type, b.entity_type as target_type from r join m a on a.id = r.source_mention_id join m b on b.id = r.target_mention_id)
select source_type, target_type, relation_type, len(subj) = 0 or list_contains(subj, source_type) as s_ok, len(obj) = 0 or list_contains(obj, target_type) as o_ok from p cross join o""",
    ).replace("len(subj) = 0 or list_contains(subj, source_type) as s_ok, len(obj) = 0 or list_contains(obj, target_type) as o_ok", "(len(subj) = 0 or list_contains(subj, source_type)) and (len(obj) = 0 or list_contains(obj, target_type)) as is_recommended")
)
def ontology_recommend(spark, sf_dir):
    """FLT7, JN12: relation types that fit a pair of entity types, by what is used between vocabulary types."""
    m, r = C.mentions(spark, sf_dir), C.relations(spark, sf_dir)
    a = m.select(F.col("id").alias("source_mention_id"), F.col("entity_type").alias("source_type"))
    b = m.select(F.col("id").alias("target_mention_id"), F.col("entity_type").alias("target_type"))
    used = r.join(a, "source_mention_id").join(b, "target_mention_id")
    seeds = table(spark, sf_dir, "seed_entities").select("entity_type").distinct()
    inside = used.join(seeds.withColumnRenamed("entity_type", "source_type"), "source_type", "left_semi").join(seeds.withColumnRenamed("entity_type", "target_type"), "target_type", "left_semi")
    types = inside.groupBy("relation_type").agg(F.collect_set("source_type").alias("subject_types"), F.collect_set("target_type").alias("object_types"))
    return suggest.recommended_relations(types, used.select("source_type", "target_type"))


@query(with_sql("s", """select id as sentence_id, 'Mark entities and relations of the current sentence only, each with evidence in it.' || chr(10) || 'Entity types:' || chr(10) || 'Material' || chr(10) || 'Relation types:' || chr(10) || 'HAS_PROPERTY' || chr(10) || 'Before: ' || coalesce(nullif(context_before, ''), '无') || chr(10) || 'Sentence: ' || text || chr(10) || 'After: ' || coalesce(nullif(context_after, ''), '无') || chr(10) || 'Run 1.' || chr(10) as prompt from s"""))
def prompt_render(spark, sf_dir):
    """SNK8: the filled prompt of each sentence."""
    return suggest.prompts(C.sentences(spark, sf_dir), "Material", "HAS_PROPERTY")


@query("""select l_suppkey as source_id, l_returnflag as relation_type, l_partkey as target_id, count(*) as evidence_count, count(distinct l_orderkey) as document_count from lineitem group by 1, 2, 3""")
def supply_graph_edges(spark, sf_dir):
    """AG5 at scale: edges between suppliers and parts, orders as their papers."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_partkey").alias("target_id")).agg(F.count("*").alias("evidence_count"), F.countDistinct("l_orderkey").alias("document_count"))


@query(
    rf"""with recursive {_GATED}, {_merged_sql("gb")},
n1 as (select document_id, block_no, page_number, unnest(x) as text, generate_subscripts(x, 1) as pos from (select document_id, block_no, page_number, case when category = 'equation' then [text] else {_units("text")} end as x from mb where category <> 'heading')),
n2 as (select document_id, page_number, text, (row_number() over (partition by document_id order by page_number, block_no, pos) - 1)::int as ordinal, {_formula("text")} as is_formula from n1),
n3 as (select *, case when not is_formula then text end as prose from n2)
select document_id || '-' || ordinal as id, document_id, ordinal, page_number, text,
  case when is_formula then last_value(prose ignore nulls) over (partition by document_id order by ordinal rows between unbounded preceding and 1 preceding) else lag(text) over (partition by document_id order by ordinal) end as context_before,
  case when is_formula then first_value(prose ignore nulls) over (partition by document_id order by ordinal rows between 1 following and unbounded following) else lead(text) over (partition by document_id order by ordinal) end as context_after, is_formula
from n3"""
)
def ingested_sentences(spark, sf_dir):
    """SRC3, SRC7: sentences made anew from the blocks of digital papers (tested on parser output)."""
    return ingest.ingested(_parsed(spark, sf_dir)).select("id", "document_id", "ordinal", "page_number", "text", "context_before", "context_after", "is_formula")


@query(with_sql("p s", f"select s.id as sentence_id, s.ordinal, case when {_formula('s.text')} then 'formula' else 'sentence' end as content_type from s where document_id = (select min(id) from p)"))
def sentence_listing(spark, sf_dir):
    """PRJ2, SRT2, FLT1: the first paper's sentences with their kind."""
    first = C.papers(spark, sf_dir).agg(F.min("id").alias("document_id"))
    rows = C.sentences(spark, sf_dir).join(first, "document_id", "left_semi")
    return rows.select(F.col("id").alias("sentence_id"), "ordinal", F.when(X.is_formula(F.col("text")), "formula").otherwise("sentence").alias("content_type"))


@query(with_sql("s m r", f"""{_EDGES}, t as (select node_id, count(*) as n from n group by 1 order by n desc, node_id limit 160)
select ed.* from ed where source_id in (select node_id from t) and target_id in (select node_id from t)"""))
def drawn_edges(spark, sf_dir):
    """JN14, LIM2: edges between the nodes that are drawn."""
    n = graph.global_nodes(C.mentions(spark, sf_dir), C.sentences(spark, sf_dir), C.entities(spark, sf_dir))
    return graph.edges_within(_edges(spark, sf_dir), graph.top_nodes(n)).select("source_id", "relation_type", "target_id", "evidence_count", "document_count")


@query(with_sql("m", """x as (select sentence_id, text, entity_type, start_offset, end_offset, source from m) select distinct a.sentence_id, a.text, a.entity_type, a.start_offset, a.end_offset from x a
where a.source = 'llm' and not exists (select 1 from x b where b.source = 'manual' and a.sentence_id is not distinct from b.sentence_id and a.text is not distinct from b.text and a.entity_type is not distinct from b.entity_type and a.start_offset is not distinct from b.start_offset and a.end_offset is not distinct from b.end_offset)"""))
def new_suggestions(spark, sf_dir):
    """JN15: suggested spans that no manual mention equals."""
    keys = ["sentence_id", "text", "entity_type", "start_offset", "end_offset"]
    m = C.mentions(spark, sf_dir)
    return annotate.new_suggestions(m.where("source = 'llm'").select(*keys).distinct(), m.where("source = 'manual'"), keys)


@query(with_sql("e c", """x as (select 1) select e.id, e.entity_type, count(*) filter (c.status = 'pending') as pending, count(c.id) as candidates
from e join c on e.id = c.left_entity_id or e.id = c.right_entity_id group by 1, 2"""))
def candidates_per_entity(spark, sf_dir):
    """FLT4: candidates that touch an entity on either side, by a union of both sides."""
    c = C.candidates(spark, sf_dir)
    sides = [c.select(F.col(f"{side}_entity_id").alias("id"), F.col("id").alias("candidate_id"), "status") for side in ("left", "right")]
    touched = sides[0].unionByName(sides[1]).distinct()
    return C.entities(spark, sf_dir).select("id", "entity_type").join(touched, "id").groupBy("id", "entity_type").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("candidates"))
