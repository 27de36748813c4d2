"""Noise in text from scanned pages (problem 3).

Page furniture is found by where a line stands on its page and by what the same place holds on the
pages around it. One averaged perceptron edits the rest: for each character of a word it scores keep,
replace, delete and insert, for a word whether its best edit is made, for a gap between words and for a
mark at a line end whether they are joined, and for an ideograph whether it is replaced. Whether clean
text knows a word, a pair of ideographs or what an edit makes of them is a feature among others; it comes
from a bit map sized by the number of words. The perceptron is fitted on every row of the papers' clean
text: what it says is counted in parallel, and examples stand in the fit with their counts.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import discard, materialise, table

#: Bits of the map of known words for each of them, the places a word takes in it, and its bounds: about
#: one unknown word in a thousand passes as known. Beyond the upper bound (107 million words) the job fails.
BITS_A_WORD, PLACES = 20, 4
MAP_LEAST, MAP_MOST = 1 << 24, 1 << 31
_PART = 1 << 19
EPOCHS = 3
SEED = 17
#: A fit takes at least about so many steps a round, if its counts give them; further ones only for further examples.
STEPS = 2000
#: How often a word of clean text is shown with each part misrecognised, and whole for each of those.
NOISY, WHOLE = 20, 3
#: What a kind of example weighs in the fit of its group, however many examples the text gives.
SHARES = {
    "known": 2000, "misread": 4000, "right": 200, "code": 600, "cut": 3000, "compound": 1500, "mark": 2,
    "divided": 3000, "beside": 3000, "strange": 3000, "wrong sign": 2000, "right sign": 2000,
}
#: A line is a running head if its text stands at the edge of at least so many of the paper's pages.
HEAD_PAGES, HEAD_SHARE = 3, 0.12
#: Pages a running head or a series of page numbers is counted over begin at every so many pages, twice as many.
REACH = 25
EDGE = 3
#: Edits of one word that are tried for a known outcome, the best first.
BEAM = 400

_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"
_WORD = re.compile(rf"[^\W_{_CJK}]+")
_IDEOGRAPH = re.compile(f"[{_CJK}]")
_HYPHENS = "-‐­¬"
_HYPHENATED = re.compile(rf"(?<![^\W_{_CJK}])([^\W_{_CJK}]+)[-‐]([^\W_{_CJK}]+)")
_CUT = re.compile(rf"((?:(?![{_CJK}])[^\W_])+)([{_HYPHENS}])$")
# What scanners commonly take for what (fixed values): recognised text, true text.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("in", "m"), ("m", "in"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"),
    ("vv", "w"), ("w", "vv"), ("li", "h"), ("0", "o"), ("1", "l"), ("l", "1"), ("I", "l"), ("l", "I"), ("l", "i"), ("i", "l"), ("1", "i"),
    ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("u", "v"),
    ("v", "u"), ("n", "u"), ("é", "e"), ("à", "a"), ("í", "i"), ("ó", "o"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("2", "z"), ("q", "g"), ("o", "0"),
)
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "9": "g", "8": "b", "6": "b", "c": "e", "h": "b", "f": "t", "v": "u"})


# Words known from clean text ------------------------------------------------------------------------


def _places(word: str, mask: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(word)
    return [((h & 0xFFFFFFFF) + i * ((h >> 32) | 1)) & mask for i in range(PLACES)]


def map_bits(words: int) -> int:
    """The bits of a map of so many words, a power of two."""
    bits = max(MAP_LEAST, 1 << max(0, words * BITS_A_WORD - 1).bit_length())
    if bits > MAP_MOST:
        raise ValueError(f"{words} known words need a map of more than {MAP_MOST} bits")
    return bits


def _shape(ch: str) -> str:
    """A character as it counts in pairs: ideographs and marks as they are, words and numbers by class."""
    if _IDEOGRAPH.match(ch):
        return ch
    return "0" if ch.isdigit() else "A" if ch.isalnum() else ch


def _folded(word: str) -> str:
    return re.sub(r"\d+", "0", word.lower())


class _Shapes(dict):
    """The shapes of characters for str.translate."""

    def __missing__(self, code: int) -> int:
        self[code] = out = ord(_shape(chr(code)))
        return out


_SHAPES = _Shapes()


def shapes_of(text: str) -> str:
    """The shapes of a text without white space, both ends marked."""
    return "^" + "".join(text.split()).translate(_SHAPES) + "$"


def clean_words(texts: Iterable[str]) -> set[str]:
    """What clean texts make known: their words, their hyphenated compounds and their pairs of ideographs."""
    words: set[str] = set()
    pairs: set[tuple[str, str]] = set()
    out: set[str] = set()
    for text in texts:
        words.update(_WORD.findall(text))
        if "-" in text or "‐" in text:
            out.update(f"{a}-{b}".lower() for a, b in _HYPHENATED.findall(text))
        if _IDEOGRAPH.search(text):
            shapes = shapes_of(text)
            pairs.update(zip(shapes, shapes[1:]))
    out.update(map(_folded, words))
    out.update(a + b for a, b in pairs if _IDEOGRAPH.match(a) or _IDEOGRAPH.match(b))
    return out


class Known:
    """The map of known words."""

    def __init__(self, raw: bytes):
        self.raw, self.mask = raw, len(raw) * 8 - 1

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh3_64_intdigest(word)
        at, step = h & 0xFFFFFFFF, (h >> 32) | 1
        for _ in range(PLACES):
            k = at & self.mask
            if not self.raw[k >> 3] >> (k & 7) & 1:
                return False
            at += step
        return True

    @staticmethod
    def of(texts: Iterable[str]) -> Known:
        words = clean_words(texts)
        raw = bytearray(map_bits(len(words)) // 8)
        for w in words:
            for k in _places(w, len(raw) * 8 - 1):
                raw[k >> 3] |= 1 << (k & 7)
        return Known(bytes(raw))


def known_words(spark: SparkSession, clean: DataFrame) -> Known:
    """The map over all rows of ``clean`` (text); only the packed map comes to the driver."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = clean_words(filter(None, batch.column(0).to_pylist()))
            values = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.sort(values), pa.int64())], names=["h"])

    def pack(cells: pa.Table) -> pa.Table:
        part = np.zeros(_PART // 8, dtype=np.uint8)
        at = cells.column("at").to_numpy()
        np.bitwise_or.at(part, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"part": cells.column("part")[:1], "bits": pa.array([part.tobytes()], pa.binary())})

    words = materialise(clean.select(F.col("text").cast("string")).mapInArrow(hashes, "h bigint").distinct(), "words")
    bits = map_bits(words.count())
    low, step = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("bigint"))
    cell = F.explode(F.array(*[(low + step * i).bitwiseAND(bits - 1) for i in range(PLACES)])).alias("cell")
    cells = words.select(cell).select(F.shiftright("cell", 19).cast("int").alias("part"), F.col("cell").bitwiseAND(_PART - 1).cast("int").alias("at"))
    raw = bytearray(bits // 8)
    for row in cells.groupBy("part").applyInArrow(pack, "part int, bits binary").toLocalIterator():
        raw[row.part * _PART // 8 : (row.part + 1) * _PART // 8] = row.bits
    return Known(bytes(raw))


# The character editor -------------------------------------------------------------------------------


class Perceptron:
    """Multi-class averaged perceptron over sparse features."""

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: Iterable[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] = out.get(label, 0.0) + w
        return out

    def fit(self, examples: list[tuple[Iterable[str], str, float]], epochs: int = EPOCHS, seed: int = SEED) -> Perceptron:
        """The weights from (features, label, size of the step); what nothing is known of is kept."""
        rng = random.Random(seed)
        total: dict[tuple[str, str], float] = {}
        stamp: dict[tuple[str, str], int] = {}
        step = 0
        order = list(range(len(examples)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, gold, size = examples[k]
                step += 1
                s = self.scores(features)
                guess = max(sorted(s), key=s.__getitem__) if s else "K"
                if guess == gold:
                    continue
                for f in features:
                    row = self.weights.setdefault(f, {})
                    for label, d in ((gold, size), (guess, -size)):
                        at = (f, label)
                        total[at] = total.get(at, 0.0) + (step - stamp.get(at, 0)) * row.get(label, 0.0)
                        stamp[at] = step
                        row[label] = row.get(label, 0.0) + d
        for f, row in self.weights.items():
            for label in row:
                at = (f, label)
                row[label] = round((total.get(at, 0.0) + (step - stamp.get(at, 0)) * row[label]) / max(step, 1), 4)
        return self


def _steps(counts: Iterable[tuple[Iterable[str], str, float]]) -> list[tuple[Iterable[str], str, float]]:
    """Counted examples as steps of a size of at most one that add up to the counts."""
    return [(x, y, n / times) for x, y, n in counts for times in (max(1, -int(-n // 1)),) for _ in range(times)]


def _window_features(a: str, b: str, c: str, d: str, e: str) -> list[str]:
    return [f"c{c}", f"l{b}{c}", f"r{c}{d}", f"t{b}{c}{d}", f"L{a}{b}{c}", f"R{c}{d}{e}", f"w{a}{b}{c}{d}{e}"]


def _char_features(word: str, i: int) -> list[str]:
    return _window_features(*f"<<{word}>>"[i : i + 5])


def _corrupt(word: str, seen: str, true: str, at: int) -> tuple[str, list[str]]:
    """The word with ``true`` at a place recognised as ``seen``, and the edit of each character."""
    noisy = word[:at] + seen + word[at + len(true) :]
    ops = ["K"] * len(noisy)
    if len(seen) == len(true):
        for k in range(len(seen)):
            ops[at + k] = f"R{true[k]}" if seen[k] != true[k] else "K"
    elif len(seen) > len(true):
        ops[at] = f"R{true[0]}"
        ops[at + 1] = "D"
    else:
        ops[at] = f"R{true[0]}I{true[1]}"
    return noisy, ops


def _spots(word: str) -> list[tuple[str, str, int]]:
    return [(seen, true, i) for seen, true in CONFUSIONS if true in word for i in range(len(word)) if word.startswith(true, i)]


def char_examples(words: Iterable[str]) -> Counter[tuple[str, str]]:
    """(five characters, edit of the middle one) of clean words and of the same words with each one part misrecognised."""
    out: Counter[tuple[str, str]] = Counter()
    for word in words:
        if len(word) < 3:
            continue
        spots = _spots(word)
        for noisy, ops, n in [(word, "K" * len(word), WHOLE * max(1, len(spots))), *((*_corrupt(word, *spot), NOISY) for spot in spots)]:
            pad = f"<<{noisy}>>"
            for i, op in enumerate(ops):
                out[pad[i : i + 5], op] += n
    return out


def fit_chars(counts: Iterable[tuple[str, str, int]]) -> dict[str, dict[str, float]]:
    """The weights from all counted (five characters, edit) of one middle character.

    Every feature holds the middle character, so the characters' weights never meet and each is fitted by itself.
    """
    rows = sorted(counts)
    unit = max(1, sum(n for _, _, n in rows) // max(STEPS, len(rows)))
    return Perceptron().fit(_steps((_window_features(*window), op, n / unit) for window, op, n in rows)).weights


def _apply(word: str, i: int, op: str) -> str:
    if op == "D":
        return word[:i] + word[i + 1 :]
    out = word[:i] + op[1] + word[i + 1 :]
    return out[: i + 1] + op[3] + out[i + 1 :] if len(op) == 4 else out


def _size(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value > b for b in bounds)


class Editor:
    """One perceptron for all edits; what clean text knows is among its features."""

    def __init__(self, known: Known, model: Perceptron, follows: dict[str, str]):
        self.known, self.model, self.follows = known, model, follows
        self.__setstate__((known, model, follows))

    def __getstate__(self):
        return self.known, self.model, self.follows

    def __setstate__(self, state):
        self.known, self.model, self.follows = state
        self.seen: dict[str, tuple[bool, str | None, int]] = {}
        self.asked: dict[str, bool] = {}

    def _best(self, features: list[str], other: str) -> bool:
        """Whether the label ``other`` scores more than keep."""
        s = self.model.scores(features)
        return s.get(other, 0.0) > s.get("K", 0.0)

    def is_known(self, word: str) -> bool:
        found = self.asked.get(word)
        if found is None:
            if len(self.asked) > 500_000:
                self.asked.clear()
            found = self.asked[word] = _folded(word) in self.known
        return found

    def pair_known(self, a: str, b: str) -> bool:
        key = a + "\n" + b
        found = self.asked.get(key)
        if found is None:
            found = self.asked[key] = (a + b) in self.known
        return found

    # words

    def edit(self, word: str) -> tuple[str | None, int, float]:
        """The best edit with a known outcome and its place, or (None, place of the best edit), with its lead over keep."""
        lower, options = word.lower(), []
        for i in range(len(lower)):
            s = self.model.scores(_char_features(lower, i))
            keep = s.get("K", 0.0)
            options += [(value - keep, i, op) for op, value in s.items() if op[0] in "RD"]
        options.sort(reverse=True)
        for lead, i, op in options[:BEAM]:
            fixed = _apply(lower, i, op)
            if _folded(fixed) in self.known:
                return fixed, i, lead
            if op[0] == "R" and len(op) == 2 and i + 1 < len(lower) and _folded(both := _apply(fixed, i + 1, "D")) in self.known:
                return both, i, lead
        return None, options[0][1] if options else -1, options[0][0] if options else 0.0

    def word_features(self, word: str, known: bool, fixed: str | None, lead: float) -> list[str]:
        if known:
            return ["word known"]
        letters = sum(c.isalpha() for c in word)
        mixed = letters < len(word)
        state = f"unknown|{'fixed' if fixed is not None else 'open'}"
        return [
            "word unknown", state, f"{state}|lead{_size(lead, (-60, -30, -15, -5, 0, 5, 15))}", f"{state}|letters{_size(letters, (1, 2, 4, 8, 16))}|{mixed}",
            f"{state}|mixed{mixed}|{word[:1].isdigit()}", f"{state}|ascii{word.isascii()}", f"{state}|upper{word[:1].isupper()}{word[1:2].isupper()}",
        ]

    def misread(self, word: str) -> tuple[bool, str | None, int]:
        """Whether the word's best edit is made, the outcome where it is known, and the place."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.is_known(word)
            fixed, at, lead = (None, -1, 0.0) if known else self.edit(word)
            found = self.seen[word] = self._best(self.word_features(word, known, fixed, lead), "E"), fixed, at
        return found

    # joins

    def join_features(self, left: str, mark: str, right: str) -> list[str]:
        whole = self.is_known(left + right)
        fixed = not whole and len(left + right) > 4 and self.edit(left + right)[0] is not None
        compound = f"{left}-{right}".lower() in self.known
        a, b = self.is_known(left), self.is_known(right)
        soft = "soft" if mark in "­¬" else "hard"
        return [f"line {x}" for x in (f"whole{whole}", f"whole{whole}|compound{compound}|{soft}", f"{soft}", f"fixed{fixed}|{compound}|{soft}", f"parts{a}{b}|{compound}|{whole}|{fixed}", f"upper{right[:1].isupper()}")]

    def joins(self, left: str, mark: str, right: str) -> bool:
        """Whether a word cut at a line end goes on without the mark."""
        return self._best(self.join_features(left, mark, right), "J")

    def gap_features(self, left: str, right: str) -> list[str]:
        a, b, whole = self.is_known(left), self.is_known(right), self.is_known(left + right)
        return [f"gap {a}{b}{whole}", f"gap {a}{b}{whole}|{min(len(left), 3)}|{min(len(right), 3)}", f"gap {whole}"]

    def closes(self, left: str, right: str) -> bool:
        """Whether two words are one that was wrongly divided."""
        return self._best(self.gap_features(left, right), "M")

    # ideographs

    @staticmethod
    def sign_features(before: bool, after: bool, far_before: bool, far_after: bool) -> list[str]:
        return [f"sign {before}{after}", f"sign {before}{after}|{far_before}{far_after}"]

    def sign(self, left: str, right: str) -> str | None:
        """The ideograph that most often stands between its neighbours."""
        return next((c for c in self.follows.get(left, "") if right in self.follows.get(c, "") and _IDEOGRAPH.match(c)), None)

    def signs(self, shapes: list[str]) -> list[int]:
        """Places of the ideographs that are replaced, in a list of shapes with both ends marked."""
        sign = [False, *(s not in "A0" and bool(_IDEOGRAPH.match(s)) for s in shapes[1:-1]), False]
        pair = [self.pair_known(shapes[n], shapes[n + 1]) if sign[n] or sign[n + 1] else True for n in range(len(shapes) - 1)]
        pair = [True, *pair, True]
        out = []
        for n in range(1, len(shapes) - 1):
            if sign[n] and not (pair[n] and pair[n + 1]):
                features = self.sign_features(pair[n], pair[n + 1], pair[n - 1], pair[n + 2] if n + 2 < len(pair) else True)
                if self._best(features, "Z"):
                    out.append(n)
        return out


_COMPOUND = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,})[-‐]([^\W\d_]{2,})")


def clean_forms(texts: Iterable[str]) -> Counter[tuple[str, str, str]]:
    """What clean texts hold, by kind: words (w), compounds (c), neighbouring words (g), neighbouring shapes of which
    one is an ideograph (f), and the shapes on both sides of an ideograph (s)."""
    words: set[str] = set()
    out: Counter[tuple[str, str, str]] = Counter()
    pairs, near, around = Counter(), Counter(), Counter()
    for text in texts:
        found = _WORD.findall(text)
        words.update(found)
        pairs.update(zip(found, found[1:]))
        if "-" in text or "‐" in text:
            out.update(("c", a.lower(), b.lower()) for a, b in _COMPOUND.findall(text) if not _IDEOGRAPH.search(a + b))
        if _IDEOGRAPH.search(text):
            shapes = shapes_of(text)
            near.update(zip(shapes, shapes[1:]))
            around.update(zip(shapes, shapes[1:], shapes[2:]))
    signs = {c for pair in near for c in pair if _IDEOGRAPH.match(c)}
    lower = {w: w.lower() for w in words if w.isalpha()}
    out.update(("w", w, "") for w in set(lower.values()))
    for (a, b), n in pairs.items():
        if a in lower and b in lower:
            out["g", lower[a], lower[b]] += n
    for (a, b), n in near.items():
        if a in signs or b in signs:
            out["f", a, b] += n
    for (a, c, b), n in around.items():
        if c in signs:
            out["s", a, b] += n
    return out


def edit_examples(forms: Iterable[tuple[str, str, str, int]], editor: Editor, seed: int = SEED) -> Counter[tuple[str, tuple[str, ...], str]]:
    """(kind of example, features, label) from all forms of clean text, counted.

    Every word is shown whole, misread in one and in two parts, cut and divided; where, its own seed draws. As
    clean text will hold words and pairs that the map doesn't, a share is shown as unknown and right. A wrong
    ideograph is any ideograph of the text in any place of one.
    """
    out: Counter[tuple[str, tuple[str, ...], str]] = Counter()

    def show(kind: str, features: list[str], label: str, n: int = 1) -> None:
        out[kind, tuple(features), label] += n

    signs = {c for c in {*editor.follows, *"".join(editor.follows.values())} if _IDEOGRAPH.match(c)}
    after = {a: signs.intersection(row) for a, row in editor.follows.items()}
    before: dict[str, set[str]] = {}
    for a in signs:
        for b in editor.follows.get(a, ""):
            before.setdefault(b, set()).add(a)
    right_signs = 0
    for kind, a, b, n in forms:
        if kind == "w":
            rng = random.Random(f"{seed} {a}")
            spots = _spots(a)
            show("known", editor.word_features(a, True, None, 0.0), "K")
            show("right", editor.word_features(a, False, None, editor.edit(a)[2]), "K")
            once = _corrupt(a, *rng.choice(spots))[0] if spots else a
            twice = _corrupt(once, *rng.choice(again))[0] if (again := _spots(once)) else once
            for noisy, times in ((once, 4), (twice, 1)) if spots else ():
                if not editor.is_known(noisy):
                    fixed, _, lead = editor.edit(noisy)
                    for word, upper in ((noisy, 4), (noisy.capitalize(), 1)):
                        for outcome, open_ in ((fixed, 17), (None, 3)):
                            show("misread", editor.word_features(word, False, outcome, lead), "E", times * upper * open_)
            if len(a) >= 5:
                at = rng.randint(2, len(a) - 2)
                show("cut", editor.join_features(a[:at], rng.choice(_HYPHENS), a[at:]), "J", 2)
                show("divided", editor.gap_features(a[:at], a[at:]), "M")
                at = rng.randint(2, len(once) - 2)
                show("cut", editor.join_features(once[:at], rng.choice(_HYPHENS), once[at:]), "J")
        elif kind == "c":
            show("compound", editor.join_features(a, "-", b), "K")
        elif kind == "g":
            show("beside", editor.gap_features(a, b), "K", n)
            show("strange", editor.gap_features(a[::-1] + "q", b), "K", n)  # a word clean text doesn't know beside one it does
        elif kind == "s":
            left, right = after.get(a, set()), before.get(b, set())
            both = len(left & right)
            for known, times in (((True, True), both), ((True, False), len(left) - both), ((False, True), len(right) - both), ((False, False), len(signs) - len(left) - len(right) + both)):
                if times:
                    show("wrong sign", editor.sign_features(*known, True, True), "K" if all(known) else "Z", n * times)
            right_signs += n
    for k in range(16 if right_signs else 0):  # each pair around a right ideograph is unknown one time in five
        flags = [bool(k >> i & 1) for i in range(4)]
        show("right sign", editor.sign_features(*flags), "K", right_signs * 4 ** sum(flags))
    return out


def fit_edits(counts: Counter[tuple[str, tuple[str, ...], str]], editor: Editor, seed: int = SEED) -> dict[str, dict[str, float]]:
    """The weights for words, joins, gaps and ideographs, each group by itself, from all counted examples."""
    counts = Counter(counts)
    if any(kind == "known" for kind, _, _ in counts):
        rng = random.Random(seed)
        for k in range(SHARES["code"]):
            code = "".join(rng.choice("abcxyz") if j == k % 2 else rng.choice("0123456789") for j in range(rng.randint(2, 5)))
            if not editor.is_known(code):
                fixed, _, lead = editor.edit(code)
                counts["code", tuple(editor.word_features(code, False, fixed, lead)), "K"] += 1
    counts["mark", ("line soft",), "J"] = counts["mark", ("line hard",), "K"] = 1
    totals: Counter[str] = Counter()
    for (kind, _, _), n in counts.items():
        totals[kind] += n
    groups: dict[str, list[tuple[tuple[str, ...], str, float]]] = {}
    for kind, features, label in sorted(counts):
        groups.setdefault(features[0].split()[0], []).append((features, label, counts[kind, features, label] * SHARES[kind] / totals[kind]))
    out: dict[str, dict[str, float]] = {}
    for group in groups.values():
        out.update(Perceptron().fit(_steps(group), seed=seed).weights)
    return out


def train(texts: Iterable[str], known: Known, seed: int = SEED) -> Editor:
    """The editor from clean texts held in memory, the same as :func:`fit_editor` makes from tables."""
    forms = clean_forms(texts)
    model = Perceptron()
    by: dict[str, list[tuple[str, str, int]]] = {}
    for (window, op), n in char_examples(a for kind, a, _ in forms if kind == "w").items():
        by.setdefault(window[2], []).append((window, op, n))
    for rows in by.values():
        model.weights.update(fit_chars(rows))
    follows: dict[str, list[tuple[int, str]]] = {}
    for (kind, a, b), n in forms.items():
        if kind == "f":
            follows.setdefault(a, []).append((n, b))
    editor = Editor(known, model, {a: "".join(b for _, b in sorted(row, reverse=True)) for a, row in follows.items()})
    model.weights.update(fit_edits(edit_examples(((*form, n) for form, n in forms.items()), editor, seed), editor, seed))
    return editor


# Page furniture -------------------------------------------------------------------------------------

_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUMBERED = re.compile(r"^[\s\-–—·•|\[\(<~*_.:]*(?:page|seite|p\.|s\.|第)?\s*([0-9lIOoSZ|]{1,5}|[ivxlcdm]{1,8})\s*(?:页|頁|ページ)?[\s\-–—·•|\]\)>~*_.:]*(?:(?:of|von|/|共)\s*[0-9lIOo]{1,5}\s*(?:页|頁)?)?[\s\-–—]*$", re.I)
_EDGE_NUMBER = re.compile(r"^\s*([0-9lIOo]{1,5})\s{2,}\S|\S\s*(?:\s{2,}|\|\s*)([0-9lIOo]{1,5})\s*$")
_DIGIT_FOLD = str.maketrans("lIOoSZ|", "1100521"[:7])


def page_number(line: str) -> int | None:
    """The number of a line that holds a page number only, misread digits included."""
    m = _NUMBERED.match(line)
    if not m or re.fullmatch(r"\s*\(\s*\d+\s*\)\s*", line):
        return None
    raw = m.group(1)
    digits = raw.translate(_DIGIT_FOLD)
    if digits.isdigit() and any(c.isdigit() for c in raw):
        return int(digits)
    low = raw.lower()
    if _ROMAN.fullmatch(low) and low and (raw.islower() or raw.isupper()):
        value, last = 0, 0
        for ch in reversed(low):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[ch]
            value, last = (value - v, last) if v < last else (value + v, v)
        return value
    return None


def skeleton(line: str) -> str:
    """A line's letters with the shapes that scanners mix up made equal."""
    low = "".join(c for c in unicodedata.normalize("NFKD", line.lower()) if c.isalnum() and not c.isdigit() or c in "0159")
    low = re.sub(r"(?<![^\W\d_])[0159]+(?![^\W\d_])", "", low)
    low = low.replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("in", "m")
    return re.sub(r"\d", "", low.translate(_FOLD))


def head_keys(line: str) -> list[str]:
    """Keys under which a running head is counted over a paper: its beginning and its end."""
    numberless = re.sub(r"^\s*[0-9lIOo]{1,5}\s{2,}|(?:\s{2,}|\s*\|\s*)[0-9lIOo]{1,5}\s*$", "", line)
    s = skeleton(numberless)
    if len(s) < 5:
        return []
    short = len(s) <= 18
    return [f"H{s}"] if short and len(s) < 10 else [f"H{s[:18]}", f"T{s[-10 if short else -16:]}"]


def edges(lines: list[str]) -> list[int]:
    """The places of a page's first two and last few lines with text."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*filled[:2], *filled[-EDGE:]})


def page_marks(text: str, page_no: int | None) -> set[str]:
    """What a page contributes to its paper's marks."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out: set[str] = set()
    for i in edges(lines):
        number = page_number(lines[i])
        if number is not None:
            if page_no is not None:
                out.add(f"N{number - page_no}")
        elif i in filled[:1] + filled[-2:]:
            out.update(head_keys(lines[i]))
    return out


def furniture(text: str, page_no: int | None, marks: set[str], whole_page: bool = True) -> list[int]:
    """Places of the furniture lines of a page, or of a passage cut from pages."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    if not filled:
        return []
    inner = not whole_page
    spots = filled[1:-1] if inner else edges(lines)
    out = []
    for i in spots:
        line = lines[i]
        number = page_number(line)
        if number is not None:
            offsets = [f"N{number - page_no - d}" for d in ((0, 1, -1) if inner else (0,))] if page_no is not None else []
            outermost = i in (filled[0], filled[-1])
            framed = bool(re.search(r"[-–—·•\[\]|页頁]|page|of", line, re.I))
            if any(o in marks for o in offsets) or (outermost and framed and whole_page) or (inner and (framed or line.strip().isdigit())):
                out.append(i)
            continue
        keys = head_keys(line)
        if not keys or not any(k in marks for k in keys):
            continue
        if whole_page and page_no == 1 and i == filled[0] and not _EDGE_NUMBER.search(line):
            continue  # the paper's own title
        out.append(i)
    if whole_page:
        # what stands below a page number of the paper's series, or above one at the top, is margin too
        for i in list(out):
            number = page_number(lines[i])
            if number is not None and page_no is not None and f"N{number - page_no}" in marks:
                at = filled.index(i)
                out += [f for f in (filled[at + 1 :] if at > 1 else filled[:at] if page_no != 1 else []) if f not in out and len(lines[f]) < 120]
    if whole_page and out:
        # furniture stands outside the content: a head in the second place needs furniture before it
        keep = set(out)
        if len(filled) > 1 and filled[1] in keep and filled[0] not in keep and filled[1] not in filled[-EDGE:]:
            keep.discard(filled[1])
        for at in range(len(filled) - 2, max(len(filled) - 1 - EDGE, 0), -1):
            if filled[at] in keep and not all(f in keep for f in filled[at + 1 :]) and filled[at] not in filled[:2]:
                keep.discard(filled[at])
        out = sorted(keep)
    return out


# Lines and their defects ----------------------------------------------------------------------------


def first_word(text: str, furn: list[int]) -> str | None:
    """The first word of a page's content."""
    for i, line in enumerate(text.split("\n")):
        if line.strip() and i not in furn:
            m = _WORD.match(line.strip())
            return m.group() if m else ""
    return None


def last_cut(text: str, furn: list[int]) -> str | None:
    """The word and mark at the end of a page's content, where its last line ends in a mark."""
    filled = [x for i, x in enumerate(text.split("\n")) if x.strip() and i not in furn]
    m = _CUT.search(filled[-1].strip()) if filled else None
    return m.group() if m else None


def defects(text: str, furn: list[int], following: str | None, editor: Editor, preceding: str | None = None) -> tuple[list[tuple[int, str]], list[str]]:
    """(line place, defect) of a record, and its repaired paragraphs.

    ``following`` is the first word of the content on the paper's next page, ``preceding`` the word and
    mark that end the content of the page before.
    """
    lines = text.split("\n")
    away = set(furn)
    found: set[tuple[int, str]] = {(i, "furniture") for i in furn}
    content = [i for i in range(len(lines)) if i not in away and lines[i].strip()]
    # one stream of text with the line each part comes from; a mark that falls away leaves nothing
    parts: list[str] = []
    starts: list[int] = []
    origin: list[int] = []
    breaks: list[int] = []
    size = 0

    def put(piece: str, line: int) -> None:
        nonlocal size
        parts.append(piece)
        starts.append(size)
        origin.append(line)
        size += len(piece)

    if preceding and content:
        m = _WORD.match(lines[content[0]].strip())
        if m and editor.joins(preceding[:-1], preceding[-1], m.group()):
            put(preceding[:-1], -1)
    for k, i in enumerate(content):
        line = lines[i].strip()
        last = k + 1 == len(content)
        after = (following or "") if last else lines[content[k + 1]].strip()
        if k and i - content[k - 1] > 1 and not any(j in away for j in range(content[k - 1] + 1, i)):
            breaks.append(size)
        m = nxt = None
        if line[-1] in _HYPHENS:
            m, nxt = _CUT.search(line), _WORD.match(after)
        if m and nxt and editor.joins(m.group(1), m.group(2), nxt.group()):
            found.add((i, "broken"))
            put(line[: m.start(2)], i)
            if last:
                put(nxt.group(), -1)
            continue
        put(line, i)
        if not last and not m and not (_IDEOGRAPH.match(line[-1]) and (_IDEOGRAPH.match(after) or not after[:1].isalnum())) and after[:1] not in "。，、；：！？）":
            put(" ", i)
    stream = "".join(parts)

    def owner(at: int) -> int:
        return origin[bisect_right(starts, at) - 1]

    edits: list[tuple[int, int, str]] = []
    tokens = list(_WORD.finditer(stream))
    unknown = [not editor.is_known(t.group()) if any(c.isalpha() for c in t.group()) else False for t in tokens]
    k = 0
    while k < len(tokens):
        a = tokens[k]
        if k + 1 < len(tokens) and (unknown[k] or unknown[k + 1]):
            b = tokens[k + 1]
            gap = stream[a.end() : b.start()]
            if gap == " " and a.group().isalpha() and b.group().isalpha() and (len(a.group()) > 1 or unknown[k + 1]) and editor.closes(a.group(), b.group()):
                found.add((owner(a.end() - 1), "misread"))
                edits.append((a.end(), b.start(), ""))
                k += 2
                continue
        if unknown[k]:
            wrong, fixed, at = editor.misread(a.group())
            line = owner(a.start() + max(at, 0))
            if wrong and line >= 0:
                found.add((line, "misread"))
            if wrong and fixed is not None:
                edits.append((a.start(), a.end(), fixed.capitalize() if a.group()[:1].isupper() else fixed))
        k += 1
    if _IDEOGRAPH.search(stream):
        at = [i for i, c in enumerate(stream) if not c.isspace()]
        shapes = ["^", *(_shape(stream[i]) for i in at), "$"]
        for n in editor.signs(shapes):
            i = at[n - 1]
            if (line := owner(i)) >= 0:
                found.add((line, "misread"))
            if (right := editor.sign(shapes[n - 1], shapes[n + 1])) is not None:
                edits.append((i, i + 1, right))
    return sorted(found), _rebuild(stream, edits, breaks)


def _rebuild(stream: str, edits: list[tuple[int, int, str]], breaks: list[int]) -> list[str]:
    """The paragraphs of a stream with its edits made."""
    paragraphs, current, at = [], [], 0
    todo, k = sorted(edits), 0
    for cut in [*breaks, len(stream)]:
        while k < len(todo) and todo[k][0] < cut:
            a, b, piece = todo[k]
            k += 1
            if a >= at:
                current += [stream[at:a], piece]
                at = b
        current.append(stream[at:cut])
        at = max(at, cut)
        paragraphs.append("".join(current).strip())
        current = []
    return [p for p in paragraphs if p]


# Operators ------------------------------------------------------------------------------------------


def paper_marks(pages: DataFrame) -> DataFrame:
    """(document_id, stretch, marks): running heads and page-number series around the pages of a stretch.

    Pages are counted in overlapping ranges of two stretches, so a head of one chapter of a long volume
    counts as in a short paper, and no range holds more marks than its pages bring. Pages without a paper
    or a number have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ranges, keys = [], [], []
            for doc, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for key in ["pages", *(page_marks(text, page) if text else ())]:
                    for first in (page // REACH - 1, page // REACH):
                        docs.append(doc)
                        ranges.append(first)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(ranges, pa.int32()), pa.array(keys, pa.string())], names=["document_id", "range", "key"])

    rows = pages.where("document_id is not null and page_number is not null and text is not null").select("document_id", "page_number", "text")
    counted = rows.mapInArrow(run, "document_id string, range int, key string").groupBy("document_id", "range", "key").agg(F.count("*").alias("n"))
    counted = counted.withColumn("pages", F.max(F.when(F.col("key") == "pages", F.col("n"))).over(W.partitionBy("document_id", "range")))
    least = F.greatest(F.lit(HEAD_PAGES), F.ceil(F.col("pages") * HEAD_SHARE))
    kept = counted.where((F.col("key") != "pages") & ((F.col("n") >= least) | (F.col("key").startswith("N") & (F.col("n") >= 2))))
    served = kept.select("document_id", F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("stretch"), "key")
    return served.groupBy("document_id", "stretch").agg(F.array_sort(F.collect_set("key")).alias("marks"))


_LINES = "record_id string, line_no int, defect string"
_TEXTS = "record_id string, paragraph_no int, text string"


def scan_lines(pages: DataFrame, passages: DataFrame, editor: Editor, repaired: bool = False) -> DataFrame:
    """(record_id, line_no, defect) of pages and passages, or with ``repaired`` their paragraphs.

    ``pages``: record_id, document_id, block_no, page_number, text, a row per page; ``passages``:
    record_id, document_id, page_number, text. Lines count from 1, empty ones included. Null and empty
    texts have no defect; records without a paper have no running heads. Repeated rows give repeated
    results; further columns are ignored.
    """
    spark = pages.sparkSession
    marks = paper_marks(pages)
    shared = spark.sparkContext.broadcast(editor)
    columns = ["record_id", "document_id", "block_no", "page_number", "text"]
    both = (
        pages.select(*columns).withColumn("page", F.lit(True))
        .unionByName(passages.withColumn("block_no", F.lit(None).cast("int")).select(*columns).withColumn("page", F.lit(False)))
        .where("text is not null and text <> ''")
        .withColumn("stretch", F.floor(F.col("page_number") / REACH).cast("int"))
        .join(marks, ["document_id", "stretch"], "left")
        .select(*columns, "page", "marks")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, firsts, ends = [], [], []
            for page_no, text, page, keys in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
                furn = furniture(text, page_no, set(keys or ()), page)
                found.append(furn)
                firsts.append(first_word(text, furn) if page else None)
                ends.append(last_cut(text, furn) if page else None)
            arrays = [batch.column(i) for i in range(6)] + [pa.array(found, pa.list_(pa.int32())), pa.array(firsts, pa.string()), pa.array(ends, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "page", "furn", "first", "cut"])

    ddl = "record_id string, document_id string, block_no int, page_number int, text string, page boolean, furn array<int>, first string, cut string"
    placed = materialise(both.mapInArrow(place, ddl), "pages")
    paged = placed.where("page and block_no is not null")
    beside = (
        paged.select("document_id", (F.col("block_no") - 1).alias("block_no"), F.col("first").alias("following"), F.lit(None).cast("string").alias("preceding"))
        .unionByName(paged.select("document_id", (F.col("block_no") + 1).alias("block_no"), F.lit(None).cast("string").alias("following"), F.col("cut").alias("preceding")))
        .groupBy("document_id", "block_no")
        .agg(F.min("following").alias("following"), F.min("preceding").alias("preceding"))
    )
    joined = placed.join(beside, ["document_id", "block_no"], "left").select("record_id", "text", "furn", "following", "preceding")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows: list[list] = [[], [], []]
            for key, text, furn, following, preceding in zip(*(batch.column(i).to_pylist() for i in range(5))):
                lines, paragraphs = defects(text, furn, following, fitted, preceding)
                if repaired:
                    rows[0] += [key] * len(paragraphs)
                    rows[1] += range(1, len(paragraphs) + 1)
                    rows[2] += paragraphs
                else:
                    for at, defect in lines:
                        for column, value in zip(rows, (key, at + 1, defect)):
                            column.append(value)
            names = ["record_id", "paragraph_no", "text"] if repaired else ["record_id", "line_no", "defect"]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string())], names=names)

    return joined.mapInArrow(judge, _TEXTS if repaired else _LINES)


def clean_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text known to be clean: papers' digital layer and the names of entities."""
    read = lambda name: table(spark, sf_dir, name)
    digital = [read(name).where("layer = 'digital'").select("text") for name in ("structured_blocks", "sentences")]
    names = [read(name).select(F.concat_ws(" ", "preferred_name", "aliases_json").alias("text")) for name in ("canonical_entities", "seed_entities")]
    out = digital[0]
    for part in (*digital[1:], *names):
        out = out.unionByName(part)
    return out


def _count(forms: DataFrame, columns: dict[str, str], examples: Callable[[pa.RecordBatch], Counter]) -> DataFrame:
    """The sums of what ``examples`` counts in each batch, by ``columns``, name and type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.string()) if t.startswith("array") else pa.string() for t in columns.values()]
        for batch in batches:
            found = examples(batch)
            keys = zip(*found) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types)), pa.array(found.values(), pa.int64())], names=[*columns, "n"])

    ddl = ", ".join(f"`{name}` {t}" for name, t in columns.items())
    return forms.mapInArrow(run, f"{ddl}, n bigint").groupBy(*columns).agg(F.sum("n").alias("n"))


def fit_texts(texts: DataFrame, known: Known) -> Editor:
    """The editor from every row of ``texts`` (text); to the driver come the fitted weights and sums by feature only."""
    spark = texts.sparkSession
    strings = lambda names: dict.fromkeys(names, "string")
    forms = _count(texts.select("text").where("text is not null"), strings(("kind", "a", "b")), lambda batch: clean_forms(batch.column(0).to_pylist()))
    forms = materialise(forms, "forms")
    rows = forms.where("kind = 'f'").groupBy("a").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "b")), False), lambda x: x.b), "").alias("row"))
    follows = {r.a: r.row for r in rows.collect()}

    def fit(cells: pa.Table) -> pa.Table:
        weights = fit_chars(zip(cells.column("window").to_pylist(), cells.column("op").to_pylist(), cells.column("n").to_pylist()))
        flat = [(f, label, w) for f, row in weights.items() for label, w in row.items()]
        return pa.table({name: pa.array(column, t) for name, column, t in zip(("feature", "label", "weight"), zip(*flat) if flat else [()] * 3, (pa.string(), pa.string(), pa.float64()))})

    windows = _count(forms.where("kind = 'w'").select("a"), strings(("window", "op")), lambda batch: char_examples(batch.column(0).to_pylist()))
    windows = windows.withColumn("middle", F.substring("window", 3, 1)).repartition(spark.sparkContext.defaultParallelism, "middle")
    model = Perceptron()
    fitted = windows.groupBy("middle").applyInArrow(fit, "feature string, label string, weight double").toArrow()
    for feature, label, weight in zip(*(c.to_pylist() for c in fitted.columns)):
        model.weights.setdefault(feature, {})[label] = weight
    editor = Editor(known, model, follows)
    shared = spark.sparkContext.broadcast(editor)
    columns = {"kind": "string", "features": "array<string>", "label": "string"}
    counted = _count(forms.where("kind <> 'f'"), columns, lambda batch: edit_examples(zip(*(c.to_pylist() for c in batch.columns)), shared.value))
    counts = Counter({(r.kind, tuple(r.features), r.label): r.n for r in counted.collect()})
    shared.destroy()
    discard(forms)
    model.weights.update(fit_edits(counts, editor))
    return editor


def fit_editor(spark: SparkSession, sf_dir: str) -> Editor:
    """The editor of a data folder: the map over all clean text, the perceptron over all of the papers' digital layer."""
    known = known_words(spark, clean_sources(spark, sf_dir))
    digital = [table(spark, sf_dir, name).where("layer = 'digital'").select(key, "text") for name, key in (("structured_blocks", "block_id"), ("sentences", "id"))]
    return fit_texts(digital[0].distinct().unionByName(digital[1].withColumnRenamed("id", "block_id").distinct()), known)


def _scanned(spark: SparkSession, sf_dir: str, repaired: bool) -> DataFrame:
    pages = table(spark, sf_dir, "structured_blocks").where("layer = 'scan'").withColumnRenamed("block_id", "record_id")
    rows = table(spark, sf_dir, "sentences").where("layer = 'scan'").withColumnRenamed("id", "record_id")
    columns = ["record_id", "document_id", "page_number", "text"]
    return scan_lines(pages.select(*columns, "block_no"), rows.select(*columns), fit_editor(spark, sf_dir), repaired)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective lines of scanned pages and passages."""
    return _scanned(spark, sf_dir, False).distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of scanned pages and passages."""
    return _scanned(spark, sf_dir, True)


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
SQL: dict[str, str] = {}
