"""Problem 10: visually identical texts in one form, by Viterbi over lattices of look-alike letters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LATIN = "aceopxyijshdqwvABCEHIJKMNOPSTXYZ"
CYRILLIC = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "i": "і", "j": "ј", "s": "ѕ", "h": "һ", "d": "ԁ", "q": "ԛ", "w": "ԝ", "v": "ѵ",
            "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "Ү"}
GREEK = {"o": "ο", "v": "ν", "j": "ϳ", "c": "ϲ", "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ"}
# Further single look-alikes, which stand for their plain letter.
OTHERS = {"У": "Y", "ı": "i", "ɡ": "g", "ɑ": "a", "Ӏ": "I", "ӏ": "l", "ⅼ": "l", "ꓳ": "O", "Ϲ": "C", "Ϳ": "J", "ո": "n", "օ": "o"}
# Characters that show nothing.
IGNORED = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# The compatibility forms that look like the plain characters.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

SCRIPTS = ({c: c for c in LATIN}, CYRILLIC, GREEK)
#: Each look-alike letter to the Latin letter of its class, and each class to its letters.
CLASS = {letter: name for script in SCRIPTS for name, letter in script.items()} | OTHERS
MEMBERS = {name: "".join(dict.fromkeys(s[name] for s in SCRIPTS if name in s)) for name in LATIN}
_CLASSES = {ord(letter): name for letter, name in CLASS.items() if letter != name}
SCRIPT_OF = {letter: i for i, script in enumerate(SCRIPTS) for letter in script.values()}

_TABLE: dict[int, str | None] = {ord(c): None for c in IGNORED} | {c: None for c in range(0xFE00, 0xFE10)}


class _Plain(dict):
    """For str.translate: characters whose compatibility form looks the same, decomposed."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.decomposition(char).split(" ")[0]
        if unicodedata.category(char) == "Zs":
            self[code] = " "
        elif kind in SAME_LOOK:
            self[code] = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(char).split(" ")[1:]).translate(self)
        else:
            self[code] = char
        return self[code]


_PLAIN = _Plain(_TABLE)


def replaced(text: str, table: dict[int, str | None]) -> str:
    """str.translate, character by character only where the text has many that change: the others are replaced one after another, which is faster in long texts.

    What a character becomes holds none that changes.
    """
    odd = {c: new for c in set(text) if (new := table[ord(c)] if ord(c) in table or isinstance(table, _Plain) else c) != c}
    for c, new in odd.items():
        text = text.replace(c, new or "")
    return text


def plain(text: str) -> str:
    """Ignorable characters deleted, look-alike compatibility forms replaced, canonically decomposed."""
    return text if text.isascii() else unicodedata.normalize("NFD", replaced(unicodedata.normalize("NFD", text), _PLAIN))


#: Characters of the texts that are taken through at once.
TOGETHER = 2_000_000


def joined(texts: list[str]) -> Iterator[tuple[str, str]]:
    """The texts in turn, many in one string, with the character between them, which none of them has."""
    block: list[str] = []
    size = 0

    def told() -> tuple[str, str]:
        mark = next(chr(c) for c in range(0xE000, 0xF8FF) if not any(chr(c) in t for t in block))
        return mark.join(block), mark

    for text in texts:
        if block and size + len(text) > TOGETHER:
            yield told()
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield told()


def script(char: str) -> int:
    """0 Latin, 1 Cyrillic, 2 Greek, 3 any other letter."""
    code = ord(char)
    return 0 if code < 0x250 or 0x1E00 <= code < 0x1F00 else 1 if 0x400 <= code < 0x530 else 2 if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else 3


#: The maximal runs of letters and the marks on them; no run holds a blank.
_WORD = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff])+")
_WORDS = _WORD.findall

#: Letters of look-alike classes, in each script.
_NEAR = frozenset(SCRIPT_OF)


def _bigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of neighbouring letters in the words of one script, counted in the task; '^' and '$' stand at either end of a word.

    Only pairs with a look-alike letter: of which there are as many as the letters of three scripts allow.
    """
    tokens: Counter[str] = Counter()
    counts: Counter[str] = Counter()

    def told() -> None:
        for word, times in ((w, n) for token, n in tokens.items() for w in _WORDS(token)):
            bare = word if word.isascii() else "".join(c for c in word if not unicodedata.combining(c))
            if bare.isascii() or len({script(c) for c in bare}) == 1:
                for a, b in zip("^" + bare, bare + "$", strict=True):
                    if a in _NEAR or b in _NEAR:
                        counts[a + b] += times
        tokens.clear()

    for frame in frames:
        for block, _ in joined(frame["text"].tolist()):
            tokens.update(plain(block).split(" "))
            if len(tokens) > Canonical.KEPT:
                told()
    told()
    if counts:
        yield pd.DataFrame({"pair": list(counts), "n": list(counts.values())})


def letter_model(documents: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of the letter pairs that hold a look-alike letter, in all words of one script, over all documents.

    What reaches the driver is bounded by the alphabets of the three scripts.
    """
    counted = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(_bigrams, "pair string, n long")
    return {r[0]: r[1] for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class Canonical:
    """Words to their one form: of all readings of the look-alike letters the likeliest in a single run of Viterbi.

    The lattice of a word depends on the classes of its letters only, so words that look the same become equal.
    """

    #: Cost of a change of script within a word.
    CHANGE = 12.0
    #: Words, and what stands between blanks, kept between texts.
    KEPT = 200_000

    def __init__(self, pairs: dict[str, int]):
        totals: dict[str, int] = {}
        for pair, n in pairs.items():
            totals[pair[0]] = totals.get(pair[0], 0) + n
        self.cost = {pair: -math.log(n / (totals[pair[0]] + 400)) for pair, n in pairs.items()}
        self.unseen = {a: -math.log(0.5 / (n + 400)) for a, n in totals.items()}
        self.known: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        changed = a != "^" and b != "$" and script(a) != script(b)
        return self.cost.get(a + b, self.unseen.get(a, 6.0)) + self.CHANGE * changed

    def word(self, name: str) -> str:
        """`name` has its look-alike letters replaced by their classes."""
        if (out := self.known.get(name)) is None:
            bare = [c for c in name if not unicodedata.combining(c)]
            best = {"^": (0.0, "")}
            for c in bare:
                best = {x: min(((cost + self.step(a, x), path + x) for a, (cost, path) in best.items()), key=lambda p: (p[0], p[1])) for x in MEMBERS.get(c, c)}
            path = min(((cost + self.step(a, "$"), p) for a, (cost, p) in best.items()), key=lambda p: (p[0], p[1]))[1]
            letters = iter(path)
            out = unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else next(letters) for c in name))
            if len(self.known) < self.KEPT:
                self.known[name] = out
        return out

    def token(self, token: str) -> str:
        """What stands between two blanks, with its words in their one form."""
        if (out := self.tokens.get(token)) is None:
            out = _WORD.sub(lambda m: self.word(m[0]), token)
            if len(self.tokens) < self.KEPT:
                self.tokens[token] = out
        return out

    def text(self, text: str) -> str:
        """The one form of a whole text: what stands between two blanks is read once, however often it occurs."""
        tokens = replaced(plain(text), _CLASSES).split(" ")
        forms = {token: self.token(token) for token in set(tokens)}
        return " ".join(map(forms.__getitem__, tokens))

    def texts(self, texts: list[str]) -> list[str]:
        """The one form of each text; many are read at once."""
        return [form for block, mark in joined(texts) for form in self.text(block).split(mark)]


def one_form(documents: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """The documents with their text in one form in `out`, so that texts that look the same become equal.

    Ignorable characters are deleted, blanks of any width become one plain blank each, compatibility forms of the same look (full width,
    ligatures) their plain letters, and accents are composed. Each word is then read through the lattice of its look-alike letters
    (Latin, Cyrillic, Greek); Viterbi takes the reading that the letter pairs of all documents and one script per word make likeliest. Case,
    digits, accents, line breaks and the number of blanks stay.

    Cases: null stays null, an empty text empty; texts of any length are read whole; an existing column `out` is replaced; an empty
    table gives an empty one. Superscripts, circled letters and fractions keep their look and so their characters.
    """
    model = letter_model(documents, text)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Canonical(shared.value)
        for part in parts:
            texts = part.tolist()
            forms = iter(reader.texts([t for t in texts if t is not None]))
            # from a list: pandas would widen all strings to the longest
            yield pd.Series([None if t is None else next(forms) for t in texts], dtype=object)

    return documents.withColumn(out, read(F.col(text)))
