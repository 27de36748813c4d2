"""Sentence units across languages and scripts (problem 1).

A semi-Markov segmenter: whole sentence spans compete, each scored by its closing words, the words
that open what follows, its length and whether its quotes and brackets are balanced; the best sequence
of spans is found by dynamic programming over the places where a sentence may end. Word weights are
fitted on rows cut by an earlier splitter, whose mistakes are a minority of any word's cases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import table

#: Rows of the earlier splitter the weights are fitted on, at most about so many, in stretches of a paper.
TRAINING_ROWS, STRETCH = 40_000, 50
EPOCHS = 4
UNBALANCED = 6.0
SEED = 11

# Marks that may close a sentence, what may follow them inside the unit, and where that is no boundary.
_MARKS = ".?!。！？｡．।॥…‥؟۔"
_CLOSERS = "\"'”’»)\\]）］」』】〉》›"
_END = re.compile(rf"(?:[{_MARKS}]+[{_CLOSERS}]*)+")
_CITE = re.compile(r"\[\d[\d,;–\- ]*\]|[¹²³⁰⁴-⁹][¹²³⁰⁴-⁹,–⁻]*|\d{1,3}(?:[,–-]\d{1,3})*(?![\d,–-]|\.\d|[%°])")
_THAI = re.compile("[฀-๿]")
_GAP = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PAIR = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "“": "”", "„": "“", "«": "»", "《": "》", "〈": "〉"}
_BRACKET = re.compile("[" + re.escape("".join(_PAIR) + "".join(_PAIR.values()) + '"') + "]")
_OPENING = "\"“„«‘'(（[［「『【《〈"
_CONTINUES = set(",;:，；：、،")


def _is_cjk(ch: str) -> bool:
    return "぀" <= ch <= "鿿" or "가" <= ch <= "힯" or "豈" <= ch <= "﫿"


def _is_thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _shape(word: str) -> str:
    if not word:
        return "end"
    ch = word[0]
    if ch in _OPENING:
        return "q" + (_shape(word[1:])[0] if len(word) > 1 else "")
    if ch.isdigit():
        return "digit"
    if _is_cjk(ch):
        return "cjk"
    if ch.isupper():
        return "Upper1" if len(word.rstrip(".,")) == 1 else "Upper"
    if ch.islower():
        return "prefixed" if word[1:2] == "-" and word[2:3].isupper() else "lower"
    return "thai" if _is_thai(ch) else "alpha" if ch.isalpha() else "other"


class Place:
    """A place where a sentence may end: the end of the unit, the start of the next, and its features."""

    __slots__ = ("end", "start", "depth", "features")

    def __init__(self, end: int, start: int):
        self.end, self.start, self.depth, self.features = end, start, 0, ()


def places(text: str) -> list[Place]:
    """All places where a sentence of ``text`` may end before the text does."""
    out: list[Place] = []
    n = len(text)
    for m in _END.finditer(text):
        a, b = m.span()
        mark = m.group()
        before, after = text[a - 1 : a], text[b : b + 1]
        ascii_dot = mark[0] == "." and mark.count(".") == len(mark) == 1
        if ascii_dot and before.isdigit() and after.isdigit():
            continue
        cite = _CITE.match(text, b)
        cited = False
        if cite and not (before.isdigit() and mark == "." and cite.group()[0].isdigit()):
            e = cite.end()
            nxt = text[e : e + 1]
            # full-width marks take their numbers in brackets: bare digits behind them open a sentence
            glued_number = cite.group()[0].isdigit() and mark[-1] in "。！？।．"
            if not glued_number and (nxt == "" or nxt.isspace() or nxt.isupper() or not nxt.isascii() or nxt in _OPENING):
                b, cited = e, True
                after = nxt
        gap = _GAP.match(text, b)
        start = gap.end() if gap else b
        if start >= n:
            break
        nxt = text[start]
        if nxt in _CONTINUES:
            continue
        if not gap and mark[-1] not in "。！？｡।॥．" and not (nxt.isupper() or not nxt.isascii() and nxt.isalpha() or nxt in _OPENING):
            continue
        if ascii_dot and not gap and before.isupper() and not cited:
            continue
        place = Place(b, start)
        place.features = _features(text, a, mark, b, start, cited)
        out.append(place)
    if _THAI.search(text):
        taken = {p.end for p in out}
        for m in _GAP.finditer(text):
            a, b = m.span()
            if a in taken or not a or b >= n:
                continue
            place = Place(a, b)
            place.features = _features(text, a, " ", a, b, False)
            out.append(place)
        out.sort(key=lambda p: p.end)
    _depths(text, out)
    return out


def _depths(text: str, found: list[Place]) -> None:
    """Open quotes and brackets at the end of each place."""
    if not found:
        return
    marks = [m.start() for m in _BRACKET.finditer(text)]
    stack: list[str] = []
    k = 0
    for place in found:
        while k < len(marks) and marks[k] < place.end:
            at, ch = marks[k], text[marks[k]]
            k += 1
            if ch == '"':
                before, after = text[at - 1 : at], text[at + 1 : at + 2]
                opens = after.strip() != "" and (before.strip() == "" or before in _OPENING) and after not in ".,;:)"
                if opens:
                    stack.append('"')  # quotes of one shape may nest
                elif '"' in stack:
                    del stack[len(stack) - 1 - stack[::-1].index('"') :]
            elif stack and ch == stack[-1]:
                stack.pop()
            elif ch in _PAIR:
                stack.append(_PAIR[ch])
            elif ch in stack:
                del stack[len(stack) - 1 - stack[::-1].index(ch) :]
        place.depth = len(stack)


def _word_before(text: str, at: int) -> str:
    start = max(0, at - 24)
    piece = text[start:at]
    cut = max(piece.rfind(" "), piece.rfind("\n"), piece.rfind(" ")) + 1
    word = piece[cut:]
    if word and (_is_cjk(word[-1]) or _is_thai(word[-1])):
        word = word[-(6 if _is_thai(word[-1]) else 2) :]
    return _DIGITS.sub("0", word.lstrip(_OPENING))[-12:]


def _features(text: str, a: int, mark: str, b: int, start: int, cited: bool) -> tuple[str, ...]:
    before = _word_before(text, a)
    left = a - len(before) if before else a
    rest = text[start : start + 24]
    gap = _GAP.search(rest)
    word = rest[: gap.start()] if gap else rest
    after = _DIGITS.sub("0", word)
    shape = _shape(word)
    core = mark.rstrip("\"'”’»)]）］」』】〉》›")
    kind = core[-1:] * min(len(core), 2) if core.strip() else " "
    closed = "c" if len(core) < len(mark) else ""
    opening = after.lstrip(_OPENING)
    ends = "digit" if before[-1:] == "0" else "single" if len(before) == 1 and before.isalpha() else "short" if len(before) <= 3 else "word"
    out = [
        "bias" + kind,
        f"m{kind}{closed}{shape}",
        f"w{kind}{before}",
        f"v{kind}{before}|{shape}",
        f"e{kind}{ends}|{shape}",
        f"o{kind.strip() and 'x'}{opening[:10]}",
    ]
    if cited:
        out.append("cited" + kind)
    if closed:
        out.append(f"k{mark[-2:]}{after[:1]}")
    if shape in ("cjk", "thai", "alpha", "qc", "qt", "qa"):
        out += [f"p{kind}{opening[:1]}", f"q{kind}{opening[:3]}", f"r{kind}{opening[:6]}"]
    if len(before) <= 4:
        prior = _word_before(text, max(0, a - len(before) - 1)) if left > 0 else ""
        initials = len(prior) == 2 and prior[0].isupper() and prior[1] == "."
        out += [f"i{kind}{initials}|{ends}|{shape}", f"b{kind}{prior}|{before}", f"c{kind}{before}|{opening[:10]}"]
    return tuple(out)


_LENGTHS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)


def _bucket(length: int) -> int:
    return sum(length > x for x in _LENGTHS)


def fit(rows: Iterable[tuple[str, str]]) -> dict:
    """Weights from (row, text of the next row) pairs: a row's end is a boundary, marks inside it are none.

    Logistic regression with per-feature step sizes; lengths get the log ratio of how often spans of
    that length are rows against how often they merely lie between two marks.
    """
    examples: list[tuple[tuple[str, ...], int]] = []
    spans, cuts = np.ones(len(_LENGTHS) + 1), np.full(len(_LENGTHS) + 1, 2.0)
    for text, following in rows:
        text = text.strip()
        if not text:
            continue
        joined = text + " " + (following or "").strip()[:40]
        last = 0
        for p in places(joined):
            if p.end > len(text):
                break
            at_end = p.end >= len(text)
            examples.append((p.features, int(at_end)))
            if not at_end:
                cuts[_bucket(p.end - last)] += 1
                last = p.start
        spans[_bucket(len(text))] += 1
    counts: dict[str, int] = {}
    for names, _ in examples:
        for f in names:
            counts[f] = counts.get(f, 0) + 1
    # a feature of few cases would only learn the earlier splitter's mistakes by heart
    least = 5 if len(examples) > 20_000 else 2
    examples = [(tuple(f for f in names if counts[f] >= least), label) for names, label in examples]
    weights: dict[str, float] = {}
    grads: dict[str, float] = {}
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)).tolist():
            names, label = examples[k]
            z = 0.0
            for f in names:
                z += weights.get(f, 0.0)
            z = max(-30.0, min(30.0, z))
            g = label - 1.0 / (1.0 + math.exp(-z))
            for f in names:
                h = grads[f] = grads.get(f, 0.05) + g * g
                w = weights.get(f, 0.0)
                weights[f] = w + 0.25 * (g - 0.002 * w) / math.sqrt(h)
    share = (spans / spans.sum()) / (cuts / cuts.sum())
    lengths = np.clip(0.3 * np.log(share), -1.5, 0.5)
    return {"weights": {f: round(w, 4) for f, w in weights.items() if abs(w) >= 0.02}, "lengths": lengths.tolist()}


def segment(text: str, model: dict) -> list[tuple[int, int]]:
    """Spans [start, end) of the sentence units; together they hold every character but white space."""
    n = len(text)
    begin = n - len(text.lstrip())
    stop = len(text.rstrip())
    if begin >= stop:
        return []
    found = [p for p in places(text[:stop]) if begin < p.end < stop]
    if not found:
        return [(begin, stop)]
    weights, lengths = model["weights"], model["lengths"]
    starts = [begin] + [p.start for p in found]
    depths = [0] + [p.depth for p in found]
    ends = [p.end for p in found] + [stop]
    whole = Place(stop, stop)
    _depths(text[:stop], [whole])
    closing = [sum(weights.get(f, 0.0) for f in p.features) for p in found] + [0.0]
    after = depths[1:] + [whole.depth]
    k = len(ends)
    best, back = [0.0] + [-math.inf] * k, [0] * (k + 1)
    if k <= 12:
        for j in range(k):
            top, arg = -math.inf, 0
            for i in range(j + 1):
                s = best[i] + lengths[_bucket(ends[j] - starts[i])] - (UNBALANCED if after[j] != depths[i] else 0.0)
                if s > top:
                    top, arg = s, i
            best[j + 1], back[j + 1] = top + closing[j], arg
    else:
        # beyond the last length bucket only a span's balance counts: of the starts that far back the best
        # of each depth and the best of all stand for the rest, so a text takes linear time
        table_of, at = np.array(lengths), np.array(starts)
        deep, score = np.array(depths), np.full(k + 1, -np.inf)
        score[0] = 0.0
        far, of_depth, of_all = 0, {}, (-math.inf, 0)
        for j in range(k):
            while far < j and ends[j] - starts[far] > _LENGTHS[-1]:
                one = (float(score[far]), -far)
                of_depth[depths[far]] = max(of_depth.get(depths[far], (-math.inf, 0)), one)
                of_all = max(of_all, one)
                far += 1
            size = np.searchsorted(_LENGTHS, ends[j] - at[far : j + 1], side="left")
            s = score[far : j + 1] + table_of[size] - UNBALANCED * (deep[far : j + 1] != after[j])
            arg = int(s.argmax())
            top = (float(s[arg]), -(far + arg))
            if far:
                plain, same = of_all, of_depth.get(after[j], (-math.inf, 0))
                top = max(top, (plain[0] + lengths[-1] - UNBALANCED, plain[1]), (same[0] + lengths[-1], same[1]))
            score[j + 1], back[j + 1] = top[0] + closing[j], -top[1]
    out, j = [], k
    while j > 0:
        out.append((starts[back[j]], ends[j - 1]))
        j = back[j]
    return out[::-1]


def training_rows(sentences: DataFrame, most: int = TRAINING_ROWS, stretch: int = STRETCH) -> list[tuple[str, str]]:
    """Rows of digital papers with the row after each, about ``most``.

    Stretches of consecutive rows are drawn by hash, so a paper of any length adds its share only.
    """
    rows = sentences.where("layer = 'digital' and text is not null and document_id is not null").select("document_id", "ordinal", "text")
    total = max(1, rows.count())
    rows = rows.withColumn("stretch", F.floor(F.col("ordinal") / stretch))
    drawn = rows.where(F.pmod(F.xxhash64("document_id", "stretch", F.lit(SEED)), F.lit(total)) < most).distinct()
    follows = F.lead("text").over(W.partitionBy("document_id", "stretch").orderBy("ordinal", "text"))
    kept = drawn.withColumn("following", follows).toArrow().to_pydict()
    order = sorted(range(len(kept["text"])), key=lambda i: (kept["document_id"][i], kept["ordinal"][i] or 0, kept["text"][i]))
    return [(kept["text"][i], kept["following"][i] or "") for i in order]


def train(sentences: DataFrame, most: int = TRAINING_ROWS) -> dict:
    """The model of the given sentences table."""
    return fit(training_rows(sentences, most))


_OUT = pa.schema([("record_id", pa.string()), ("start_at", pa.int32()), ("end_at", pa.int32())])


def units(records: DataFrame, model: dict) -> DataFrame:
    """(record_id, start_at, end_at) of the sentence units of ``records`` (record_id, text).

    Offsets count code points. Null, empty and blank texts have no unit; a text without a place to cut
    is one unit. Repeated rows give repeated units; a null id is kept. Other columns are ignored.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in segment(text, fitted) if text else ():
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_OUT)

    cols = records.select(F.col("record_id").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "record_id string, start_at int, end_at int")


def digital_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts and body blocks and the rows of the earlier splitter, of digital papers."""
    blocks = table(spark, sf_dir, "structured_blocks").where("layer = 'digital' and category in ('abstract', 'main_text')")
    rows = table(spark, sf_dir, "sentences").where("layer = 'digital'")
    return blocks.select(F.col("block_id").alias("record_id"), "text").unionByName(rows.select(F.col("id").alias("record_id"), "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of all records of digital papers."""
    model = train(table(spark, sf_dir, "sentences"))
    return units(digital_records(spark, sf_dir), model).distinct()


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
