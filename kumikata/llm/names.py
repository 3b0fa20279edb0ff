"""Problem 6: variant spellings of people's names, by phonetic blocks, Jaro-Winkler, nicknames and connected components."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumikata.llm.components import components
from kumikata.plans.runtime import cut, small, spread

# Words between given name and surname that name nobody.
PARTICLES = frozenset("de da do das dos del della di du van von der den la le los el al bin ibn y e".split())

# Short and pet forms, each with the given name it stands for.
NICKNAMES = {
    "alex": "alexandra", "ale": "alexandra", "lexi": "alexandra", "sandra": "alexandra", "dressa": "andressa", "bia": "beatriz", "bea": "beatriz", "bron": "bronwen",
    "cami": "camille", "mille": "camille", "clo": "clotilde", "dag": "dagmar", "bete": "elisabete", "beth": "elisabete", "betty": "elisabete", "lis": "elisabete",
    "telinha": "estela", "tela": "estela", "eva": "evangelina", "vange": "evangelina", "nanda": "fernanda", "fer": "fernanda", "fred": "frederica", "fredi": "frederica",
    "gabi": "gabrielle", "gaby": "gabrielle", "gunn": "gunnhild", "dassa": "hadassa", "rique": "henrique", "inga": "ingrid", "isa": "isadora", "dora": "isadora",
    "jo": "joana", "juju": "juliette", "jules": "juliette", "kat": "katarina", "kati": "katarina", "kiki": "kirsten", "liv": "livia", "mila": "ludmila", "lud": "ludmila",
    "mari": "mariela", "marge": "marjorie", "nath": "nathalia", "nati": "nathalia", "nia": "niamh", "dess": "odessa", "tavi": "otavia", "paty": "patricia", "pat": "patricia",
    "pip": "philippa", "pippa": "philippa", "quita": "quiteria", "beca": "rebeca", "becky": "rebeca", "nene": "renee", "ro": "rosangela", "rosa": "rosangela",
    "sam": "samantha", "simmy": "simone", "sofi": "sofia", "teo": "teodora", "tha": "thais", "ursi": "ursula", "tina": "valentina", "val": "valentina",
    "vivi": "vitoria", "vick": "vitoria", "mina": "wilhelmina", "willa": "wilhelmina", "xen": "xenia", "yas": "yasmin", "zuzu": "zuleica", "zu": "zuleica",
    "bob": "robert", "bill": "william", "dick": "richard", "ted": "theodore", "ze": "jose", "chico": "francisco", "nando": "fernando", "guga": "gustavo", "gus": "gustavo",
    "rafa": "rafael", "gui": "guilherme", "leo": "leonardo", "dudu": "eduardo", "edu": "eduardo", "beto": "roberto", "tom": "thomas", "mike": "michael", "andy": "andrew",
    "kate": "katherine", "liz": "elizabeth", "maggie": "margaret", "meg": "margaret", "sasha": "alexander", "xande": "alexandre", "fe": "felipe", "lipe": "felipe",
}

# The consonant classes of Soundex; vowels, h, w and y have none.
SOUND = {c: str(n) for n, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}

#: Jaro-Winkler decides how far two words may lie apart: with `most` slips (neighbours exchanged count as one) they must be as alike as
#: SIMILAR, with one slip more as alike as CLOSE.
SIMILAR, CLOSE, EDITS = 0.78, 0.95, 1

#: Forms of one phonetic block that are compared with each other as they are; a larger block is cut by the letters that its words keep.
HOT = 2_000


def repaired(text: str) -> str:
    """UTF-8 that was read as a single-byte code page, put right."""
    for page in ("latin-1", "cp1252"):
        try:
            again = text.encode(page).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        return again
    return text


@lru_cache(maxsize=50_000)
def parts(name: str) -> tuple[str, ...]:
    """The words of a name, unaccented, without particles and epithets; "Last, First" is turned round."""
    text = unicodedata.normalize("NFKD", repaired(name)).lower()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub("[\"“”«»„(\\[][^\"“”«»„)\\]]*[\"“”«»„)\\]]", " ", text)
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first} {last}"
    words = re.findall(r"[^\W\d_]+", re.sub("['’`]", "", text))
    return tuple([w for w in words if w not in PARTICLES or len(w) == 1] or words)


def parse(name: str, nicknames: dict[str, str] = NICKNAMES) -> tuple[str, str, str] | None:
    """(first, last, middle): the outer words of a name and what stands between them; a nickname becomes its given name.

    One word alone is (word, '', ''); None if there is no letter.
    """
    words = parts(name)
    if not words:
        return None
    first, last = words[0], words[-1] if len(words) > 1 else ""
    return nicknames.get(first, first), nicknames.get(last, last), " ".join(words[1:-1])


def sound(word: str) -> str:
    """The consonant classes of a word; letters of one class without a vowel between them count once."""
    out, before = "", ""
    for c in word:
        code = SOUND.get(c, "")
        if code and code != before:
            out += code
        if c not in "hw":
            before = code
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four equal letters at the start."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, [c for c, u in zip(b, used, strict=True) if u], strict=True)) / 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


def edits(a: str, b: str, most: int = EDITS) -> int:
    """Edits between two words, neighbours exchanged counted as one; more than `most` is `most` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=50_000)
def word_slips(a: str, b: str, most: int = EDITS) -> int | None:
    """The slips between two spellings of one word, None if they are no such spellings.

    Words of up to three letters must be equal.
    """
    if a == b:
        return 0
    if min(len(a), len(b)) <= 3 or (n := edits(a, b, most + 1)) > most + 1:
        return None
    return n if jaro_winkler(a, b) >= (SIMILAR if n <= most else CLOSE) else None


def middles_agree(x: str, y: str, most: int = EDITS) -> bool:
    """Whether what stands between the outer words of two names can belong to one person: each word of the shorter has its like, or its initial, in the longer."""
    short, long = sorted((x.split(), y.split()), key=len)
    return all(any(s[0] == t[0] if min(len(s), len(t)) == 1 else word_slips(s, t, most) is not None for t in long) for s in short)


Name = tuple[str, str, str]


def slips(a: Name | None, b: Name | None, most: int = EDITS) -> int | None:
    """The least number of slips between two parsed names that can name one person, their outer words in either order; None if they cannot.

    An initial agrees with its letter. `most` is 2 where few people are in question, so that two misspellings meet without the right name.
    """
    if not a or not b or not middles_agree(a[2], b[2], most):
        return None

    def agree(x: str, y: str) -> int | None:
        if not x or not y:
            return None
        if len(x) == 1 or len(y) == 1:
            return 0 if x[0] == y[0] else None
        return word_slips(x, y, most)

    found = []
    for x, y in (b[:2], b[1::-1]):
        if max(len(a[0]), len(x)) > 1 and min(len(a[1]), len(y)) > 1 or min(len(a[0]), len(x)) > 1:
            one, two = agree(a[0], x), agree(a[1], y)
            if one is not None and two is not None:
                found.append(one + two)
    return min(found, default=None)


def same_person(a: Name | None, b: Name | None, most: int = EDITS) -> bool:
    """Whether two parsed names can name one person."""
    return slips(a, b, most) is not None


def _blocks(nicknames: dict[str, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each name's parsed words and its block keys: the sound of one word and the sound of the other, whole or less one consonant."""
        for frame in frames:
            rows = []
            for scope, name in zip(frame["scope"], frame["name"], strict=True):
                parsed = parse(name, nicknames) or ("", "", "")
                two = parsed[:2]
                keys: set[str] = set()
                initial = 0
                if two[0] and two[1]:
                    initial = sum(len(w) == 1 for w in two)
                    for one, other in (two, two[::-1]):
                        if len(other) > 1:
                            code = sound(other)
                            for less in {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))}:
                                if len(one) > 1:
                                    keys.add(f"{sound(one)}|{less}")
                                else:
                                    keys.add(f"{one}:{less}")
                rows.append((scope, name, *sorted(two), parsed[2], initial, sorted(keys)))
            yield pd.DataFrame(rows, columns=["scope", "name", "word_a", "word_b", "middle", "initials", "keys"])

    return run


def _compare(most: int):
    def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pairs:
            columns = (frame[c] for c in ("word_a", "word_b", "middle", "other_a", "other_b", "other_middle"))
            found = [slips((a, b, m), (c, d, n), most) for a, b, m, c, d, n in zip(*columns, strict=True)]
            kept = frame.assign(slips=[-1 if s is None else s for s in found])
            yield kept.loc[kept["slips"] >= 0, ["form", "other", "middle", "other_middle", "slips"]]

    return run


_EDGE = "form long, other long, middle string, other_middle string, slips int"


def kept_letters(word: Column, most: int) -> Column:
    """The word and what is left of it after up to `most` letters are dropped: words within `most` slips share one of these."""
    out = F.array(word)
    for _ in range(most):
        less = F.transform(out, lambda v: F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))).otherwise(F.array(v)))
        out = F.array_distinct(F.concat(out, F.flatten(less)))
    return out


def _keyed(forms: DataFrame) -> DataFrame:
    """A row per form and block."""
    return forms.select("form", F.xxhash64("scope").alias("within"), "word_a", "word_b", "middle", F.explode(F.transform("keys", lambda k: F.xxhash64("scope", k))).alias("key"))


def _large(forms: DataFrame, hot: int) -> DataFrame | None:
    """(key, large) of the blocks with more than `hot` forms, None if there is none; only scopes with as many forms can have one."""
    crowded = cut(forms.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("scope"))
    if crowded.isEmpty():
        return None
    counts = _keyed(forms.join(small(crowded), "scope")).groupBy("key").agg(F.count("*").alias("n"))
    large = cut(counts.where(F.col("n") > hot).select("key", F.lit(True).alias("large")))
    return None if large.isEmpty() else large


def _blocked(whole: DataFrame, most: int, hot: int) -> DataFrame:
    """Pairs of forms of one block that the words' letters do not keep apart.

    A block of more than `hot` forms is cut by what is left of its words after as many letters are dropped as two spellings may differ in, so that its pairs
    are never all compared, and none is lost.
    """
    sizes = _large(whole, hot)
    full = _keyed(whole)
    if sizes is not None:
        told = full.join(small(sizes), "key", "left")
        rest = F.array_distinct(F.concat(kept_letters(F.col("word_a"), most), kept_letters(F.col("word_b"), most)))
        keys = F.when(F.col("large"), F.transform(rest, lambda v: F.xxhash64("key", v))).otherwise(F.array("key"))
        full = told.withColumn("key", F.explode(keys)).drop("large")
    other = full.select("key", *[F.col(c).alias(n) for c, n in (("form", "other"), ("within", "other_within"), ("word_a", "other_a"), ("word_b", "other_b"), ("middle", "other_middle"))])
    near = lambda x, y: f"(levenshtein({x}, {y}, {2 * most}) >= 0 AND length(translate({x}, {y}, '')) <= {most} AND length(translate({y}, {x}, '')) <= {most})"
    close = f"({near('word_a', 'other_a')} AND {near('word_b', 'other_b')} OR {near('word_a', 'other_b')} AND {near('word_b', 'other_a')})"
    met = full.join(spread(other), "key").where(f"form < other AND within = other_within AND {close}")
    return met.select("form", "other", "word_a", "word_b", "middle", "other_a", "other_b", "other_middle").distinct()


def _without_bridges(edges: DataFrame) -> DataFrame:
    """The edges less those by which a name without middle words would bring different people together.

    Such a name keeps its links to names with middle words of one initial only: that of the nearest, and none if two initials are equally near.
    """
    hang = edges.where("(middle = '') <> (other_middle = '')")
    hang = hang.select("form", "other", F.when(F.col("middle") == "", F.col("form")).otherwise(F.col("other")).alias("open"), F.substring(F.concat("middle", "other_middle"), 1, 1).alias("letter"), "slips")
    # the least and the greatest letter of those at the least distance
    ends = hang.groupBy("open").agg(F.min(F.struct("slips", "letter")).alias("a"), F.max(F.struct((-F.col("slips")).alias("near"), "letter")).alias("z"))
    one = ends.select("open", F.when(F.col("a.letter") == F.col("z.letter"), F.col("a.letter")).alias("keep"))
    kept = hang.join(spread(one), "open").where("letter = keep").select("form", "other")
    return edges.where("(middle = '') = (other_middle = '')").select("form", "other").unionByName(kept)


def link(names: DataFrame, name: str = "name", scope: str | None = None, most: int = EDITS, nicknames: dict[str, str] = NICKNAMES, hot: int = HOT) -> DataFrame:
    """Link the spellings of one person: (name, person), one row for each different name that is not null.

    `person` is the least spelling, by code point, of those linked. With a `scope` column (a string), names are linked within equal scopes only, and
    the result is (scope, name, person). Method: the outer words of a name (after repair of code pages, unaccented, without
    epithets and particles, nicknames resolved) are blocked by their phonetic codes, either order, one consonant more or less
    allowed; pairs within a block are compared by the table of `nicknames` and word by word by Jaro-Winkler, which decides how many slips may lie between them: `most`,
    or one more between words that are very much alike; words between the outer ones must not contradict each other; connected
    components of the accepted pairs are the persons. A name with an initial joins a person only if that initial and surname can
    mean no other person; likewise a name without middle words where others have different ones.

    Work is done on different word pairs, not on rows: names said a million times cost as one, and equal word pairs are never compared. Candidates
    are filtered by the JVM's edit distance, which no accepted pair exceeds, before Python sees them; large blocks are cut without loss (`_blocked`).

    Cases: a null name has no row; a name without two words is its own person, as is one of symbols only; empty input gives no
    row; other columns are ignored; very long names are read whole.
    """
    within = F.coalesce(F.col(scope), F.lit("")) if scope else F.lit("")
    distinct = names.where(F.col(name).isNotNull()).select(within.alias("scope"), F.col(name).alias("name")).distinct()
    parsed = cut(distinct.mapInPandas(_blocks(nicknames), "scope string, name string, word_a string, word_b string, middle string, initials int, keys array<string>"))
    two = parsed.where("size(keys) > 0")
    key = ["scope", "word_a", "word_b", "middle"]
    forms = two.groupBy(*key).agg(F.first("initials").alias("initials"), F.first("keys").alias("keys"), F.min("name").alias("least"))
    # a number for each form; written, so that it stays
    forms = cut(forms.withColumn("form", F.monotonically_increasing_id()))
    whole = forms.where("initials = 0")
    edges = cut(_blocked(whole, most + 1, hot).mapInPandas(_compare(most), _EDGE))
    groups = components(whole.select(F.col("form").alias("node")), _without_bridges(edges).select(F.col("form").alias("a"), F.col("other").alias("b")))
    # an initial: the persons whose one word begins so and whose other word sounds alike
    # one number for scope, letter and sound; those of a form are made different within its row
    letters = F.array_distinct(F.array(F.substring("word_a", 1, 1), F.substring("word_b", 1, 1)))
    numbers = F.flatten(F.transform(letters, lambda c: F.transform("keys", lambda k: F.xxhash64("scope", c, F.substring_index(k, "|", -1)))))
    begins = whole.select("scope", F.col("form").alias("other"), F.col("word_a").alias("other_a"), F.col("word_b").alias("other_b"), F.col("middle").alias("other_middle"), F.explode(F.array_distinct(numbers)).alias("key"))
    initial = forms.where("initials = 1").select("form", F.col("scope").alias("own_scope"), "word_a", "word_b", "middle", F.when(F.length("word_a") == 1, F.col("word_a")).otherwise(F.col("word_b")).alias("letter"), F.explode("keys").alias("k"))
    initial = initial.withColumn("key", F.xxhash64("own_scope", F.substring_index("k", ":", 1), F.substring_index("k", ":", -1))).drop("k")
    surname = F.when(F.length("word_a") > 1, F.col("word_a")).otherwise(F.col("word_b"))
    bound = 2 * (most + 1)
    apart = lambda other, letter: F.when((F.substring(letter, 1, 1) == F.col("letter")) & (F.levenshtein(surname, F.col(other), bound) >= 0), F.levenshtein(surname, F.col(other))).otherwise(99)
    met = initial.join(spread(begins), "key").where("own_scope = scope").withColumn("apart", F.least(apart("other_b", "other_a"), apart("other_a", "other_b"))).where("apart < 99")
    met = met.select("form", "other", "word_a", "word_b", "middle", "other_a", "other_b", "other_middle").distinct()
    near = met.mapInPandas(_compare(most), _EDGE).join(spread(groups.select(F.col("node").alias("other"), "component")), "other")
    # only if one person alone is at the least distance
    nearest = near.groupBy("form").agg(F.min(F.struct("slips", "component")).alias("a"), F.max(F.struct((-F.col("slips")).alias("near"), "component")).alias("z"))
    chosen = nearest.where("a.component = z.component").select(F.col("form").alias("node"), F.col("a.component").alias("component"))
    lone = forms.where("initials > 0").select(F.col("form").alias("node")).join(spread(chosen), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    told = cut(forms.select(*key, "least", F.col("form").alias("node")).join(spread(groups.unionByName(lone)), "node"))
    persons = told.join(spread(told.groupBy("component").agg(F.min("least").alias("person"))), "component").select(*key, "person")
    linked = two.select(*key, "name").join(spread(persons), key).select("scope", "name", "person")
    out = linked.unionByName(parsed.where("size(keys) = 0").select("scope", "name", F.col("name").alias("person")))
    return out if scope else out.drop("scope")
