"""Markup residue in text documents (problem 5).

A section in HTML, Markdown, wiki or LaTeX markup, or a mixture of them, is cut into leaf blocks, each
with the path of all tags and environments it stands under. A linear-chain conditional random field over the leaves, fitted
on pages rendered from papers whose block kinds are known, tells headings, paragraphs, list items, code
and formulas apart; the inline cleaner then leaves what a reader sees.
"""

from __future__ import annotations

import html
import itertools
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.crf import Crf
from graphloom.runtime import table

KINDS = ["heading", "paragraph", "list_item", "code", "formula"]
KEY_LENGTH = 80
#: Blocks of digital papers the training pages are rendered from, at most about so many.
TRAINING_BLOCKS = 4000
PAGES = 900
SEED = 13

_CODE = re.compile(
    r"<pre\b[^>]*>(?P<pre>.*?)</pre\s*>"
    r"|<(?P<sname>syntaxhighlight|source)\b[^>]*>(?P<source>.*?)</(?P=sname)\s*>"
    r"|^[ \t]*(?P<mark>```+|~~~+)[^\n]*\n(?P<fence>.*?)(?:^[ \t]*(?P=mark)[ \t]*$|\Z)"
    r"|\\begin\{(?P<vname>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?P<verb>.*?)\\end\{(?P=vname)\}"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<unseen><(?P<uname>script|style|head)\b.*?</(?P=uname)\s*>)",
    re.S | re.M | re.I,
)
_DISPLAY = re.compile(
    r"\\begin\{(?P<ename>equation|align|gather|multline|displaymath|eqnarray)(?P<star>\*?)\}(?P<env>.*?)\\end\{(?P=ename)(?P=star)\}"
    r"|<div\b[^>]*class=[\"']?math[^>]*>\s*(?P<div>.*?)</div\s*>"
    r"|<math\b[^>]*display[^>]*>(?P<block>.*?)</math\s*>"
    r"|^[ \t]*:+[ \t]*<math\b[^>]*>(?P<colon>.*?)</math\s*>[ \t]*$"
    r"|^[ \t]*\$\$(?P<dollars>.+?)\$\$[ \t]*$"
    r"|^[ \t]*\\\[(?P<square>.+?)\\\][ \t]*$",
    re.S | re.M | re.I,
)
_BLOCK_TAG = re.compile(
    r"<(?P<close>/?)(?P<name>p|div|h[1-6]|li|ul|ol|dl|dt|dd|blockquote|html|body|title|table|thead|tbody|tr|td|th|section|article|header|footer|center|hr)(?=[\s/>])[^<>]*>",
    re.I,
)
_INLINE_TAG = re.compile(
    r"</?(?:a|abbr|b|bdi|big|br|cite|code|del|dfn|em|font|i|img|ins|kbd|mark|math|nobr|nowiki|q|ref|references|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr|gallery|noinclude|includeonly)(?:\s[^<>]*)?/?>",
    re.I,
)
_MATH = re.compile(
    r"<math\b[^>]*>(?P<tag>.*?)</math\s*>|\\\((?P<round>.+?)\\\)|(?<!\\)\\\[(?P<square>.+?)\\\]"
    r"|(?<!\\)\$\$(?P<double>[^$]+)\$\$|(?<![\\$])\$(?P<one>(?!\d+ [^\W\d_]{2,})(?!\s)(?:[^$\\\n]|\\.|\n(?!\n))+?)(?<!\s)\$(?!\d)|<nowiki>(?P<literal>.*?)</nowiki>",
    re.S,
)
_LABEL = re.compile(r"\\(?:label|tag|nonumber|notag)\*?(?:\{[^{}]*\})?")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_FILE = re.compile(r"\[\[(?:File|Image|Category|Media|文件|图像|分类):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_MD_IMAGE = re.compile(r"!\[[^\[\]]*\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])")
_MD_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?[^()\s<>]*>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_MD_FOOT = re.compile(r"\[\^[^\[\]\s]+\](?::[^\n]*)?")
_URL_LINK = re.compile(r"\[(?:https?|ftp|mailto):[^\s\[\]]*\s*([^\[\]]*)\]")
_TEX_DROP = re.compile(
    r"~?\\(?:cite[a-z]*|ref|eqref|pageref|autoref|label|footnote|footnotemark|footnotetext|includegraphics|vspace|hspace|index|nocite|bibliography|bibliographystyle|thispagestyle|pagestyle|usepackage|documentclass|input|caption\*?)\*?(?:\[[^\[\]]*\])*(?:\{(?:[^{}]|\{[^{}]*\})*\})?"
)
_TEX_LINK = re.compile(r"\\href\{[^{}]*\}")
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]]*\])?")
_TEX_COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?|[,;:!/> ])|\\\\(?:\[[^\]]*\])?")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_EMPHASIS = re.compile(r"'{2,5}|(?<![\w*])\*{1,3}(?=\S)|(?<=\S)\*{1,3}(?![\w*])|(?<![\w_])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![\w_])|`+")
_SWITCH = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOINDEX|INDEX)__")
_SPACE = re.compile(r"\s+")
_BLANK = re.compile(r"\n[ \t]*\n")
_HASH = re.compile(r"(#{1,6})([ \t]*)(?=\S)")
_STAR = re.compile(r"([*]{1,4}|[-+])([ \t]*)(?=\S)")
_NUMBER = re.compile(r"\d{1,4}[.)][ \t]+(?=\S)")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\{")
_WIKI_HEAD = re.compile(r"(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
_UNDERLINE = re.compile(r"(={3,}|-{3,})[ \t]*$")
_LINK_DEF = re.compile(r"\[[^\]\n^]+\]:\s+\S+(?:\s+\"[^\"]*\")?\s*$")
_CLOSED_STAR = re.compile(r"(\*{1,3})[^\s*](?:[^*\n]{0,80}?[^\s*])?\1(?!\*)")


# Pairs of which an opening without its closing would be searched for to the end of the text, each time.
_PAIRS = tuple(
    (re.compile(o, re.I), re.compile(c, re.I))
    for o, c in (
        (r"<(?=pre\b)", r"</pre"), (r"<(?=syntaxhighlight\b)", r"</syntaxhighlight"), (r"<(?=source\b)", r"</source"), (r"<(?=script\b)", r"</script"),
        (r"<(?=style\b)", r"</style"), (r"<(?=head\b)", r"</head"), (r"<(?=math\b)", r"</math"), (r"<(?=ref\b)", r"</ref"), (r"<(?=div\b)", r"</div"),
        (r"\\(?=begin\{)", r"\\end\{"), (r"\\(?=\()", r"\\\)"), (r"\\(?=\[)", r"\\\]"), (r"<(?=nowiki>)", r"</nowiki"),
    )
)
#: Shorter texts are searched as they are.
_LONG = 4096


def unused(text: str, n: int, first: int = 0xE000) -> list[str]:
    """The first ``n`` characters of private use that are neither in the text nor named in it by a reference."""
    probe = html.unescape(text) if "&" in text else text
    free = (ch for ch in map(chr, itertools.chain(range(first, 0xF900), range(max(first, 0xF0000), 0x10FFFE))) if ch not in probe)
    return list(itertools.islice(free, n))


def paired(text: str, run) -> str:
    """``run`` of a text; openings behind the last closing of their kind, which it can't match, are kept from it."""
    if len(text) < _LONG:
        return run(text)
    hidden: list[tuple[str, str]] = []
    for opening, closing in _PAIRS:
        first = opening.search(text)
        if not first:
            continue
        last = 0
        for m in closing.finditer(text):
            last = m.end()
        if opening.search(text, last):
            mark = unused(text, 1, 0x100000)[0]
            hidden.append((mark, first.group()))
            text = text[:last] + opening.sub(lambda _: mark, text[last:])
    text = run(text)
    for mark, plain in reversed(hidden):
        text = text.replace(mark, plain)
    return text


def clean_inline(text: str) -> str:
    """What a reader sees of a leaf's text; formulas keep their TeX source without delimiters and labels."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kind = m.lastgroup
        inside = m.group(kind)
        kept.append(inside if kind == "literal" else _LABEL.sub("", inside))
        return f"{left}{len(kept) - 1}{right}"

    has = text.__contains__
    if has("<!--"):
        text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    if has("$") or has("\\") or has("<"):
        left, right = unused(text, 2)
        text = paired(text, lambda x: _MATH.sub(keep, x))
    if has("<"):
        text = paired(text, lambda x: _REF.sub("", x))
    while has("{{"):
        shorter = _TEMPLATE.sub("", text)
        if shorter == text:
            break
        text = shorter
        has = text.__contains__
    if "[" in text:
        text = _WIKI_FILE.sub("", text)
        text = _WIKI_LINK.sub(r"\1", text)
        text = _MD_IMAGE.sub("", text)
        text = _MD_LINK.sub(r"\1", text)
        text = _MD_FOOT.sub("", text)
        text = _URL_LINK.sub(r"\1", text)
    if "<" in text:
        text = _INLINE_TAG.sub(lambda m: " " if m.group()[1:3].lower() == "br" else "", text)
        text = _BLOCK_TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _TEX_DROP.sub("", text)
        text = _TEX_LINK.sub("", text)
        text = _TEX_ENV.sub("", text)
        text = _TEX_COMMAND.sub(lambda m: "" if text[m.end() : m.end() + 1] == "{" else " ", text)
        text = re.sub(r"(?<!\\)[{}]", "", text)
        text = _ESCAPED.sub(r"\1", text).replace("~", " ")
    if "_" in text or "*" in text or "'" in text or "`" in text:
        text = _SWITCH.sub("", text)
        text = _EMPHASIS.sub("", text)
    if kept:
        text = re.sub(f"{left}(\\d+){right}", lambda m: kept[int(m.group(1))], text)
    return _SPACE.sub(" ", text).strip()


def content_key(text: str) -> str:
    """Letters and digits of a text, lower-cased, cut to 80 characters."""
    return "".join(ch for ch in text if ch.isalnum() or ch.isnumeric() or ch.isalpha()).lower()[:KEY_LENGTH]


class Leaf:
    """A leaf block: the tag or mark it stands under, its raw text, what its line looked like, and its ancestors' tags."""

    __slots__ = ("tag", "text", "notes", "path")

    def __init__(self, tag: str, text: str, notes: tuple[str, ...] = (), path: tuple[str, ...] = ()):
        self.tag, self.text, self.notes, self.path = tag, text, notes, path


_LISTS = ("ul", "ol", "dl")
_CELLS = ("td", "th")
#: Tags that hold no text of their own.
_FRAMES = ("html", "body", "ul", "ol", "dl", "table", "thead", "tbody", "tr", "hr")
#: What an opening tag ends, where it is open inside the nearest of the tags named second.
_ENDS = {
    "li": (("li", "p"), _LISTS), "dt": (("dt", "dd", "p"), _LISTS), "dd": (("dt", "dd", "p"), _LISTS),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr",)), "th": (("td", "th", "p"), ("tr",)),
}
_P_ENDS = (("p", "h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "td", "th", "blockquote", "div", "section", "article"))


def _opened(path: list[str], name: str) -> None:
    """A block tag opens: it ends the tags it can't stand in, and joins the path."""
    ended, within = _ENDS.get(name, _P_ENDS)
    base = next((i for i in range(len(path) - 1, -1, -1) if path[i] in within), -1)
    at = next((i for i in range(base + 1, len(path)) if path[i] in ended), None)
    if at is not None:
        del path[at:]
    if name != "hr":
        path.append(name)


def _closed(path: list[str], name: str) -> None:
    """A block tag closes, and with it what is open inside."""
    if name in path:
        del path[len(path) - 1 - path[::-1].index(name) :]


def leaves(text: str) -> list[Leaf]:
    """The leaf blocks of a section, in order."""
    stock: list[Leaf] = []
    mark = unused(text, 1)[0]

    def cut(leaf: Leaf) -> str:
        stock.append(leaf)
        return f"\n\n{mark}{len(stock) - 1}{mark}\n\n"

    def code(m: re.Match) -> str:
        if m.group("comment") is not None:
            return ""
        if m.group("unseen") is not None:
            return "\n\n"
        if m.group("fence") is not None:
            return cut(Leaf("fence", m.group("fence")))
        if m.group("verb") is not None:
            return cut(Leaf("verbatim", m.group("verb")))
        inside = m.group("pre") if m.group("pre") is not None else m.group("source")
        if m.group("pre") is not None:
            inside = re.sub(r"\A\s*<code[^>]*>|</code>\s*\Z", "", inside, flags=re.I)
            inside = html.unescape(inside)
        return cut(Leaf("pre", inside))

    def formula(m: re.Match) -> str:
        inside = next(m.group(g) for g in ("env", "div", "block", "colon", "dollars", "square") if m.group(g) is not None)
        inside = re.sub(r"\A\s*(?:\$\$|\\\[|\\\()|(?:\$\$|\\\]|\\\))\s*\Z", "", inside)
        return cut(Leaf("display", html.unescape(_LABEL.sub("", inside)) if m.group("div") is not None else _LABEL.sub("", inside)))

    text = text.replace("\r\n", "\n")
    text = paired(text, lambda x: _CODE.sub(code, x))
    text = paired(text, lambda x: _DISPLAY.sub(formula, x))
    out: list[Leaf] = []
    path: list[str] = []
    at = 0

    def flow(piece: str) -> None:
        if not piece.strip():
            return
        if path and path[-1] not in _FRAMES:
            # a blank line ends what unclosed tags hold
            blank = _BLANK.search(piece, len(piece) - len(piece.lstrip()))
            head, rest = (piece[: blank.start()], piece[blank.end() :]) if blank else (piece, "")
            if head.lstrip().startswith(mark):
                head, rest = "", piece
            if head.strip():
                out.append(Leaf(path[-1], head, path=tuple(path)))
            if rest.strip():
                held = tuple(path)
                if not all(_cut_out(line.strip(), mark) for line in rest.split("\n") if line.strip()):
                    held = ()
                    path.clear()
                _lines(rest, out, stock, mark, held)
        else:
            _lines(piece, out, stock, mark, tuple(path))

    for m in _BLOCK_TAG.finditer(text):
        flow(text[at : m.start()])
        at = m.end()
        name = m.group("name").lower()
        if m.group("close"):
            _closed(path, name)
        else:
            _opened(path, name)
    flow(text[at:])
    return out


def _cut_out(bare: str, mark: str) -> bool:
    return len(bare) > 2 and bare[0] == mark == bare[-1]


def _group(lines: list[str], i: int, line: str, start: int) -> tuple[str, str, int]:
    """What a brace group that opens before ``start`` of a line holds, what follows on its last line, and the next line's place."""
    depth, held = 1, []
    while True:
        for k in range(start, len(line)):
            ch = line[k]
            if ch in "{}" and line[k - 1 : k] != "\\":
                depth += 1 if ch == "{" else -1
                if not depth:
                    held.append(line[start:k])
                    return "\n".join(held), line[k + 1 :], i
        held.append(line[start:])
        if i >= len(lines):
            return "\n".join(held), "", i
        line, start, i = lines[i], 0, i + 1


def _lines(piece: str, out: list[Leaf], stock: list[Leaf], mark_of_cut: str, path: tuple[str, ...] = ()) -> None:
    """Leaf blocks of text outside block tags, by its lines; TeX environments join the path."""
    first = len(out)
    held: list[str] = []
    item: Leaf | None = None
    listing, blank = False, True
    wiki = sum(piece.count(x) for x in ("''", "[[", "{{", "<ref", "<nowiki", "<math"))
    plain = sum(piece.count(x) for x in ("](", "**", "__", "[^", "```", "~~~"))
    dialect = "wiki" if wiki > plain else "plain" if plain > wiki else "none"

    def flush() -> None:
        nonlocal item
        if held:
            out.append(Leaf("text", "\n".join(held)))
            held.clear()
        item = None

    def settle() -> None:
        """The leaves so far stand under the path so far."""
        nonlocal first
        for leaf in out[first:]:
            leaf.path = path
        first = len(out)

    lines = piece.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        bare = line.strip()
        if not bare:
            flush()
            blank = True
            continue
        if _cut_out(bare, mark_of_cut):
            flush()
            leaf = stock[int(bare[1:-1])]
            leaf.path = path
            out.append(leaf)
            listing, blank = False, True
            continue
        if line.startswith(("    ", "\t")) and blank and not listing and not bare.startswith("\\item"):
            block = [line]
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                block.append(lines[i])
                i += 1
            flush()
            out.append(Leaf("indented", "\n".join(x[4:] if x.startswith("    ") else x[1:] for x in block).strip("\n")))
            blank = True
            continue
        if bare.startswith("\\"):
            frame = re.match(r"\\(begin|end)\{([^{}]*)\}(?:\[[^\]]*\])?", bare)
            if frame or re.match(r"\\(?:begin|end)\{", bare):
                flush()
                listing, blank = False, True
                if frame:
                    settle()
                    name, inner = frame.group(2), list(path)
                    if frame.group(1) == "begin":
                        inner.append(name)
                    else:
                        _closed(inner, name)
                    path = tuple(inner)
                rest = bare[frame.end() :].strip() if frame else ""
                if rest:
                    i -= 1
                    lines[i] = rest
                continue
            head = _TEX_HEAD.match(bare)
            if head:
                flush()
                title, rest, i = _group(lines, i, bare, head.end())
                out.append(Leaf("section", title))
                i -= 1
                lines[i] = rest
                listing, blank = False, True
                continue
            if re.match(r"\\item\b", bare):
                flush()
                item = Leaf("item", re.sub(r"^\\item(?:\[[^\]]*\])?\s*", "", bare))
                out.append(item)
                listing, blank = True, False
                continue
        if bare.startswith("%") and (blank or not held) and not bare.startswith("%%PDF"):
            continue
        if held and item is None and _UNDERLINE.match(bare):
            out.append(Leaf("underlined", "\n".join(held)))
            held.clear()
            blank = True
            continue
        head = _WIKI_HEAD.match(bare) if bare[0] == "=" else None
        if head:
            flush()
            out.append(Leaf("equals", head.group(2)))
            listing, blank = False, True
            continue
        if _LINK_DEF.match(bare):
            flush()
            continue
        mark = _HASH.match(bare)
        kind = "hash"
        if not mark:
            mark, kind = _STAR.match(bare), "star"
            if mark and mark.group(1) in "-+" and not mark.group(2):
                mark = None
        if not mark and (blank or listing):
            mark, kind = _NUMBER.match(bare), "number"
        if mark and (blank or listing or kind == "hash" and not held):
            emphasis = bool(kind == "star" and not mark.group(2) and _CLOSED_STAR.match(bare))
            if emphasis and dialect != "wiki":
                flush()
                held.append(bare)
                listing, blank = False, False
                continue
            run = "run" if item is not None else "alone"
            follows = lines[i].strip() if i < len(lines) else ""
            flush()
            notes = (
                run,
                "next" if follows[:1] == bare[:1] else "last",
                f"glued{'' if kind == 'number' else not mark.group(2)}",
                f"deep{'' if kind == 'number' else min(len(mark.group(1)), 3)}",
                f"{dialect}",
                f"trail{bare.endswith('#')}",
            )
            body = bare[mark.end() :]
            item = Leaf(kind, re.sub(r"\s#+$", "", body) if kind == "hash" else body, notes)
            out.append(item)
            listing, blank = kind != "hash", False  # what is indented below a heading is code
            continue
        if item is not None:
            item.text += "\n" + bare
        else:
            if blank:
                listing = False
            held.append(bare)
        blank = False
    flush()
    settle()


def features(found: list[Leaf]) -> list[list[str]]:
    """Feature names of each leaf: the tags of its ancestors, its notes and what its text looks like."""
    out = []
    for leaf in found:
        text = leaf.text.strip()
        words = text.count(" ") + 1
        size = "few" if words <= 4 else "some" if words <= 16 else "many"
        last = text[-1:]
        ends = "stop" if last in ".?!。！？" else "other"
        names = [f"tag={leaf.tag}", f"{leaf.tag}|{size}", f"size={size}", f"ends={ends}", f"{leaf.tag}|{ends}", f"upper={text[:1].isupper()}", f"lines={min(text.count(chr(10)), 2)}"]
        names += [f"{leaf.tag}|{n}" for n in leaf.notes]
        above = leaf.path[:-1] if leaf.path and leaf.path[-1] == leaf.tag else leaf.path
        names += [f"under={t}" for t in dict.fromkeys(above)] + [f"{leaf.tag}|under={t}" for t in dict.fromkeys(above)]
        names.append(f"path={'>'.join(leaf.path[-3:])}|{leaf.tag}")
        if leaf.tag == "hash":
            names += [f"hash|{a}|{b}" for a in leaf.notes[:2] for b in leaf.notes[2:5]]
            names.append(f"hash|{leaf.notes[4]}|{text[:1].isupper()}")
        out.append(names)
    return out


# Labelled pages -------------------------------------------------------------------------------------

_SNIPPETS = ("for k in range(9):\n    s[k] += 2 ** k", "$ sort -n runs.txt\n$ wc -l", "SELECT a FROM t\nWHERE a <> 3", "x = load('a')\n# == end ==", "if (q > 1) {\n  w *= 0.1;\n}")
_SHAPES = {
    "html": {"heading": ["<h2>{t}</h2>", '<h1 id="a">{t}</h1>', "<H3>\n{t}\n</H3>", "<blockquote><h2>{t}</h2></blockquote>", "<div><h3>{t}</h3></div>"], "paragraph": ["<p>{t}</p>", '<p class="b">\n{t}\n</p>', "<div>{t}</div>", "<blockquote><p>{t}</p></blockquote>", "<div><p>{t}</p></div>", "<table><tr><td>{t}</td></tr></table>", "<blockquote>{t}</blockquote>"], "code": ["<pre>{t}</pre>", "<pre><code>{t}</code></pre>"], "formula": ['<div class="math">$${t}$$</div>']},
    "plain": {"heading": ["# {t}", "## {t}", "### {t} ###", "{t}\n=======", "{t}\n-------"], "paragraph": ["{t}", "**{h}** {t}"], "code": ["```\n{t}\n```", "~~~\n{t}\n~~~", "    {t}"], "formula": ["$$\n{t}\n$$", "$${t}$$", "\\[{t}\\]"]},
    "wiki": {"heading": ["== {t} ==", "==={t}==="], "paragraph": ["{t}", "''{h}'' {t} [[{h}]]"], "code": ["<pre>\n{t}\n</pre>", '<syntaxhighlight lang="text">\n{t}\n</syntaxhighlight>'], "formula": [":<math>{t}</math>", '<math display="block">{t}</math>']},
    "tex": {"heading": ["\\section{{{t}}}", "\\subsection*{{{t}}}\\label{{a}}"], "paragraph": ["{t}", "\\emph{{{h}}} {t}"], "code": ["\\begin{{verbatim}}\n{t}\n\\end{{verbatim}}", "\\begin{{lstlisting}}\n{t}\n\\end{{lstlisting}}"], "formula": ["\\begin{{equation}}\n{t}\n\\end{{equation}}", "\\[{t}\\]"]},
}


def _render_list(r: random.Random, dialect: str, items: list[str]) -> str:
    if dialect == "html":
        close = r.choice(["</li>", ""])
        frame = r.choice(["ul", "ol"])
        if r.random() < 0.3:  # a loose list: each item holds a paragraph
            return f"<{frame}>" + "\n".join(f"<li><p>{x}</p>{close}" for x in items) + f"</{frame}>"
        if r.random() < 0.2:  # a list inside an item of another
            inner = "".join(f"<li>{x}</li>" for x in items[1:])
            return f"<{frame}><li>{items[0]}<ul>{inner}</ul></li></{frame}>"
        return "<ul>" + "\n".join(f"<li>{x}{close}" for x in items) + "</ul>"
    if dialect == "tex":
        return "\\begin{itemize}\n" + "\n".join(f"  \\item {x}" for x in items) + "\n\\end{itemize}"
    if dialect == "wiki":
        mark, gap = r.choice(["*", "#"]), r.choice(["", " "])
        return "\n".join(f"{mark * r.choice([1, 1, 1, 2] if k else [1])}{gap}{x}" for k, x in enumerate(items))
    mark = r.choice(["- ", "* ", "+ ", "1. ", "1) "])
    return "\n".join(f"{r.choice(['', '', '  ']) if k else ''}{mark.replace('1', str(k + 1))}{x}" for k, x in enumerate(items))


def labelled_pages(blocks: list[tuple[str, str]], pages: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages in every dialect rendered from (category, text) blocks, with the kind of each element."""
    r = random.Random(seed)
    titles = [" ".join(t.lstrip("# ").split()) for c, t in blocks if c == "heading" and t and t.strip("# \n")] or ["Grain size", "Results of the tests"]
    prose = [" ".join(t.split()) for c, t in blocks if c in ("main_text", "abstract") and t and t.strip()] or ["The film grew at 4 K. It did not recover.", "No change was seen."]
    maths = [" ".join(t.strip(" $\n").split()) for c, t in blocks if c == "equation" and t and t.strip(" $\n")] or ["a = b + c"]
    out = []
    for _ in range(pages):
        dialect = r.choice(list(_SHAPES))
        parts, kinds = [], []
        for _ in range(r.randint(2, 8)):
            kind = r.choice(KINDS)
            if kind == "list_item":
                items = []
                for _ in range(r.randint(2, 5)):
                    text = r.choice(re.split(r"(?<=[.。]) ?", r.choice(prose)) or prose)[:300].strip("。. ") or "one item"
                    items.append(text[0].lower() + text[1:] if r.random() < 0.5 else text)
                parts.append(_render_list(r, dialect, items))
                kinds += [kind] * len(items)
                continue
            text = {"heading": titles, "paragraph": prose, "formula": maths, "code": _SNIPPETS}[kind]
            shape, chosen = r.choice(_SHAPES[dialect][kind]), r.choice(text)
            if shape.startswith("    "):
                chosen = chosen.replace("\n", "\n    ")
            parts.append(shape.format(t=chosen, h=r.choice(titles)[:12]))
            kinds.append(kind)
        out.append(("\n\n".join(parts) if dialect != "html" or r.random() < 0.5 else "".join(parts), kinds))
    return out


def fit(blocks: list[tuple[str, str]], pages: int = PAGES) -> Crf:
    """The field fitted on labelled pages whose leaves match their elements one to one."""
    examples = []
    for text, kinds in labelled_pages(blocks, pages):
        found = [x for x, _ in seen_leaves(text)]
        # code that a list before it has drawn in is no code to a reader
        if len(found) == len(kinds) and all(x.tag in _RAW or k != "code" for x, k in zip(found, kinds)):
            examples.append((features(found), [KINDS.index(k) for k in kinds]))
    return Crf(KINDS).fit(examples)


#: Leaves whose text stays as it is.
_RAW = ("fence", "pre", "verbatim", "indented", "display")


def seen_leaves(text: str) -> list[tuple[Leaf, str]]:
    """The leaves that hold a letter or digit, each with its clean text."""
    out = []
    for leaf in leaves(text):
        raw = leaf.tag in _RAW
        clean = leaf.text.strip("\n") if raw else clean_inline(leaf.text)
        if any(ch.isalnum() for ch in clean):
            out.append((leaf, clean))
    return out


def elements(text: str, model: Crf) -> list[tuple[str, str]]:
    """(kind, clean text) of a section's structural elements that hold a letter or digit."""
    found = seen_leaves(text)
    kinds = model.decode(features([leaf for leaf, _ in found]))
    return [(kind, clean) for kind, (_, clean) in zip(kinds, found)]


def training_blocks(blocks: DataFrame, most: int = TRAINING_BLOCKS) -> list[tuple[str, str]]:
    """(category, text) of about ``most`` blocks of digital papers, drawn by hash."""
    rows = blocks.where("layer = 'digital' and text is not null").select("block_id", "category", "text")
    total = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("block_id", F.lit(SEED)), F.lit(total)) < most).distinct().toArrow().to_pydict()
    order = sorted(range(len(drawn["text"])), key=lambda i: (drawn["block_id"][i] or "", drawn["text"][i]))
    return [(drawn["category"][i], drawn["text"][i]) for i in order]


_OUT = pa.schema([("record_id", pa.string()), ("element_no", pa.int32()), ("kind", pa.string()), ("clean_text", pa.string()), ("content_key", pa.string())])
_DDL = "record_id string, element_no int, kind string, clean_text string, content_key string"


def structure(records: DataFrame, model: Crf | None) -> DataFrame:
    """(record_id, element_no, kind, clean_text, content_key) of records (record_id, text).

    With a model a record is a section of any number of elements; without one it is one paragraph. Null,
    empty and letterless texts have no element. Repeated rows give repeated elements; a null id is kept.
    Other columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = elements(text, field) if field is not None else [("paragraph", clean_inline(text))]
                for no, (kind, clean) in enumerate(found):
                    short = content_key(clean)
                    if short:
                        for column, value in zip(rows, (key, no, kind, clean, short)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _OUT)], schema=_OUT)

    return records.select(F.col("record_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def markup_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural elements of the sections and sentences of papers deposited with markup."""
    blocks = table(spark, sf_dir, "structured_blocks")
    model = fit(training_blocks(blocks))
    sections = blocks.where("layer = 'markup'").select(F.col("block_id").alias("record_id"), "text")
    rows = table(spark, sf_dir, "sentences").where("layer = 'markup'").select(F.col("id").alias("record_id"), "text")
    return structure(sections, model).unionByName(structure(rows, None))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind and content key of every structural element."""
    return markup_structure(spark, sf_dir).select("record_id", "kind", "content_key").distinct()


QUERIES = {"p5_found": p5_found, "p5_clean_text": markup_structure}
SQL: dict[str, str] = {}
