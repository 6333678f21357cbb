"""Values typed freely, mapped to the entries of a canonical list, by a prefix-filter set-similarity join and an exact check.

Every entry has several forms (name, synonyms, foreign term, code). A text is read word by word as words of the list, up to typing errors,
shortened and joined words; what it reads as, and each form, are sets of letter trigrams. Trigrams are ordered by global rarity; only rare
prefixes are looked up; length and positional filters come before the exact Jaccard value (``Forms.candidates`` with the list in each task,
``similarity_join`` as a shuffled join: both give the same pairs). No text is decided without it: codes and exact names are forms like others.

Of the similar forms the check keeps those in which every typed word is a word of the form, and of these the best: the highest Jaccard value
of the words as read there, then the fewest edits. A form with all its words typed has 1; forms with words that nobody typed stay open
together. No typed word may be one of its own: one the list knows elsewhere, or one the corpus writes in far too many distinct texts for a
slip of a list word.

A text means one entry, leaves several open, says nothing, or names what is not on the list; other fields decide only in the second and
third case.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..sources.tables import spread
from .level import mended

#: Least Jaccard value of a text, as read, and a form: half of the trigrams of either are its prefix. Of texts for which no form is whole,
#: the forms down to OPEN, as typed, stay open: one word typed of three is similar by no more.
SIMILAR, OPEN = 0.5, 0.2
#: Forms up to which each task holds the list; texts on one trigram beyond which it is split in the shuffled join.
MOST_FORMS, HOT = 50_000, 10_000
#: A word is its own if at least OFTEN keys and TEXTS distinct texts have it, and these are at least SHARE of those of the list words that it
#: resembles: of their keys, or of their distinct texts (however many keys repeat one text), one edit then having to be ONE_EDIT.
OFTEN, TEXTS, SHARE, ONE_EDIT = 4, 3, 0.04, 0.1

#: Words without content; words around a name that do not change what it means (how certain it is, what kind of note, since
#: when, with the usual abbreviations of "diagnosis"); texts that say nothing.
STOP = frozenset("de del la las los el lo un una y e en por con of the in and to a".split())
LITTLE = ("de", "del", "la", "las", "los", "el", "of")
ABOUT = frozenset(
    "dx jc dxp dg diag diagnostico diagnosticos impresion impr probable probables probablemente posible posibles posiblemente sospecha sospechas sospechoso sugestivo compatible descartar dudoso dudosa "
    "presunto presunta orientacion confirmado confirmada conocido conocida cie cie10 cod codigo control controles revision seguimiento estudio pendiente valorar mes meses semana semanas dia dias ano anos hoy ver".split()
)
NOTHING = (
    "n a|na|no aplica|ver codigo|ver informe|ver nota|ver historia|pendiente|segun volante|segun informe|no consta|no procede|no se sabe|desconocido|se desconoce|idem|igual que la anterior|igual que el anterior|lo mismo|a valorar|por valorar|"
    "sin hallazgos|sin datos|sin diagnostico|sin especificar|ninguno|ninguna|nada|x|xx|xxx|null|none|nan|vacio|sd|s d|nc|n c|otro|otros|error|prueba|test"
).split("|")
#: Beginnings that change what a word means, so that one for another is no slip.
BEGINNINGS = frozenset(("hiper hipo hyper hypo sub super supra infra micro macro mega pseudo seudo des dis dys anti contra inter intra extra endo exo ecto peri para meta epi mono bi di poli poly oligo neo iso hetero homo re pre post pro ante retro semi multi uni pan").split())
_LENGTHS = sorted({len(b) for b in BEGINNINGS})
OPPOSED = [set(p.split("/")) for p in "interno/externo interna/externa superior/inferior anterior/posterior medial/lateral internal/external upper/lower".split()]
SAME = {"agudo": "aguda", "cronico": "cronica"}

#: Two words without content written together.
STOP_PAIRS = frozenset(a + b for a in STOP for b in STOP if len(a + b) > 3)

_NO_CODE, _BEFORE_CODE = re.compile(r"[^a-z0-9.,]"), re.compile(r"cie\W*10\W*|cod(igo)?\W*")
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"\b[a-z]\s?\d\d(?:\s?[.,]\s?\d{1,2}|\d{1,2})?(?![a-z0-9])")
_NEAR = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "8": "b", "|": "l", "$": "s"}


class _Bare(dict):
    """Of each character what is left without accents and invisible marks, found once."""

    def __missing__(self, at: int) -> str:
        self[at] = out = "".join(c for c in unicodedata.normalize("NFKD", chr(at)) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        return out


_BARE = _Bare()


def plain(text: str | None) -> str:
    """Mended, lower case, without accents; null is empty."""
    if text is None or text != text:
        return ""
    return text.lower() if text.isascii() else mended(text).lower().translate(_BARE)


def code(text: str | None) -> str:
    """A code as the list writes it: ``cod. e345`` is E34.5; empty if there is none."""
    if text is None or not _DIGIT.search(text):
        return ""
    t = _NO_CODE.sub("", _BEFORE_CODE.sub("", plain(text)))
    m = re.fullmatch(r"([a-z]\d\d)[.,]?(\d{0,3})", t)
    return "" if not m else (m[1] + ("." + m[2] if m[2] else "")).upper()


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, neighbours swapped counting one; ``most`` + 1 if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # what both begin and end with takes no edit
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
    return row[-1]


def slips(word: str) -> int:
    """Edits slips of the hand may make in a word."""
    n = len(word)
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 8 else 3


def other_word(word: str, known: str) -> bool:
    """Whether the two differ by what changes meaning, not by a slip."""
    if any(word in p and known in p for p in OPPOSED):
        return True
    for a in _begins(word):
        if len(word) - len(a) >= 4:
            stem = word[len(a) :]
            for b in ("", *_begins(known)):
                if distance(a, b, 2) >= 2 and len(known) - len(b) >= 4 and distance(stem, known[len(b) :], 1) <= 1 and stem[:2] == known[len(b) :][:2]:
                    return True
    return False


def _begins(word: str) -> list[str]:
    """The beginnings that a word has."""
    return [b for n in _LENGTHS if (b := word[:n]) in BEGINNINGS]


@dataclass(frozen=True)
class Token:
    word: str
    short: bool  # cut short: marked by a dot, or the last of the text


def tokens(text: str) -> list[Token]:
    """The words of a plain text that carry content, digits in words read as the letters they resemble."""
    out = []
    found = list(re.finditer(r"[^\W_]+(?:(?<=\w)[|$](?=\w))?[^\W_]*\.?", text))
    for m in found:
        w, dot = m[0].rstrip("."), m[0].endswith(".")
        if w.isdigit():
            continue
        if not w.isalpha() and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
            w = "".join(_NEAR.get(c, c) for c in w)
        out.append(Token(w, dot or m is found[-1] and text.endswith(m[0])))
    return out


def grams(words: Iterable[Token]) -> frozenset[str]:
    out = set()
    for t in words:
        if t.word not in STOP and t.word not in ABOUT:
            s = "^" + SAME.get(t.word, t.word) + ("" if t.short and len(t.word) < 6 else "$")
            out.update(s[i : i + 3] for i in range(max(1, len(s) - 2)))
    return frozenset(out)


def code_set(cie: str) -> frozenset[str]:
    """A code as a set: itself and its category, so that a category is half of each of its codes."""
    return frozenset({"#" + cie[:3], "#" + cie})


def prefix_length(size: int, similar: float) -> int:
    return size - math.ceil(similar * size - 1e-9) + 1


class Fact(NamedTuple):
    """Of a typed word: whether a list that is not at hand has it, whether it is one of its own, and the edits to the nearest list word of
    each language."""

    listed: bool
    own: bool
    nearest: dict[str, int]


class Forms:
    """The list in memory: its forms, the index of their rare prefixes, and the check."""

    def __init__(self, entries: list[tuple[int, str, list[tuple[str, str]]]], counts: dict[str, int] | None = None, words: dict[str, tuple[int, int]] | None = None, similar: float = SIMILAR, open_: float = OPEN, facts: dict[str, "Fact"] | None = None):
        self.facts = facts or {}
        self.similar, self.open = similar, min(open_, similar)
        self.form_id: list[int] = []
        self.form_words: list[list[str]] = []
        self.codes: dict[str, int] = {}
        self.category: dict[str, set[int]] = defaultdict(set)
        self.languages: dict[str, set[str]] = {}
        sets, seen = [], set()
        for key, cie, names in entries:
            if cie:
                self.codes[cie.upper()] = key
                self.category[cie.upper()[:3]].add(key)
                self.form_id.append(key)
                self.form_words.append([])
                sets.append(code_set(cie.upper()))
            for language, name in names:
                words_ = [SAME.get(t.word, t.word) for t in tokens(name) if t.word not in STOP]
                self.languages.setdefault(language, set()).update(words_)
                if words_ and (key, tuple(words_)) not in seen:
                    seen.add((key, tuple(words_)))
                    self.form_id.append(key)
                    self.form_words.append(words_)
                    sets.append(grams(Token(w, False) for w in words_))
        counts = counts or {}
        own = Counter(g for s in sets for g in s)
        order = sorted(own, key=lambda g: (counts.get(g, 0) + own[g], g))
        self.rank = {g: i for i, g in enumerate(order)}
        self.sizes = [len(s) for s in sets]
        self.longest = max(self.sizes, default=0)
        self.bits = [sum(1 << self.rank[g] for g in s) for s in sets]
        self._after = {t: [n - prefix_length(n, t) + 1 for n in range(self.longest + 1)] for t in {self.similar, self.open}}
        # of each trigram: (form, its size, trigrams of it from this one on), for the forms that have it in their prefix
        self.index: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for f, s in enumerate(sets):
            ranks = sorted(self.rank[g] for g in s)
            for pos in range(prefix_length(len(ranks), self.open)):
                self.index[ranks[pos]].append((f, len(ranks), len(ranks) - pos))
        self.vocabulary = {w for ws in self.form_words for w in ws}
        for own_ in (self.vocabulary, *self.languages.values()):
            own_ |= {a for a, b in SAME.items() if b in own_}
        self.longer: dict[str, list[str]] = defaultdict(list)  # of each beginning the list words that have it and more
        for w in sorted(self.vocabulary):
            for n in range(2, len(w)):
                self.longer[w[:n]].append(w)
        self.longest_word = max(map(len, self.vocabulary), default=0)
        self.most_words = max(map(len, self.form_words), default=0)
        self.less: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.vocabulary):
            for d in _deletes(w, slips(w + "xxx")):
                self.less[d].append(w)
        self.around = lru_cache(200_000)(self._around)
        self.within_one = lru_cache(200_000)(self._within_one)
        self.nothing = {p.replace(" ", "") for p in NOTHING}
        self.own_words = frozenset(w for w, f in self.facts.items() if f.own or f.listed and w not in self.vocabulary) | frozenset(w for w, n in (words or {}).items() if self.own_word(w, *n, words.get))
        self.options = lru_cache(200_000)(self._options)
        self._grams_of = lru_cache(200_000)(lambda ws: grams(Token(w, False) for w in ws))
        self.candidates = lru_cache(200_000)(self._candidates)  # texts mistyped in many ways read alike
        self.meaning = lru_cache(200_000)(self._meaning)

    # --- the similarity join

    def _candidates(self, found: frozenset[str], similar: float | None = None) -> dict[int, float]:
        """{form: Jaccard} of all forms similar enough to a set of trigrams; ``similar``: not below what the index was made for."""
        size = len(found)
        if not size:
            return {}
        rank = self.rank
        # trigrams no form has come first in the order: they are the rarest
        known = sorted(rank[g] for g in found if g in rank)
        unknown = size - len(known)
        t = self.similar if similar is None else similar
        low, high = t * size, size / t
        least = [math.ceil(t / (1 + t) * (size + n) - 1e-9) for n in range(self.longest + 1)]
        after = self._after[t]  # of a form of n trigrams, those from the last of its prefix on
        seen: set[int] = set()
        passed, index = [], self.index
        for at in range(min(prefix_length(size, t) - unknown, len(known))):
            left = len(known) - at
            for f, n, right in index[known[at]]:
                if f not in seen and right >= after[n]:
                    seen.add(f)
                    if low <= n <= high and left >= least[n] and right >= least[n]:
                        passed.append(f)
        mine = 0
        for r in known:
            mine |= 1 << r
        out = {}
        for f in passed:
            both = (mine & self.bits[f]).bit_count()
            j = both / (size + self.sizes[f] - both)
            if j >= t:
                out[f] = j
        return out

    # --- the check

    def own_word(self, word: str, keys: int, texts: int, known) -> bool:
        """Whether a word of so many keys and texts is one of its own; ``known``: (keys, texts) of a list word, or None."""
        if keys < OFTEN or texts < TEXTS or word in self.vocabulary or len(word) <= 3 or self._joined(word, strict=True):
            return False
        around = self.around(word)
        if keys >= SHARE * max(((known(v) or (0, 0))[0] for v, _ in around), default=0):
            return True
        nearest = min(d for _, d in around)
        return texts > TEXTS and texts >= (ONE_EDIT if nearest == 1 else SHARE) * max((known(v) or (0, 0))[1] for v, d in around if d == nearest)

    def _around(self, word: str) -> tuple[tuple[str, int], ...]:
        """(list word, edits) of all list words within what the longer of the two allows. Words so near share one with letters left out."""
        if len(word) > self.longest_word + 3:
            return ()
        found = {v for d in _deletes(word, slips(word + "xxx")) for v in self.less.get(d, ())}
        out = []
        for v in sorted(found):
            most = slips(max(word, v, key=len))
            if (d := distance(word, v, most)) <= most:
                out.append((v, d))
        return tuple(out)

    def _within_one(self, word: str) -> tuple[tuple[str, int], ...]:
        """Of ``around`` those at one edit or none: they share a word with at most one letter left out of each."""
        if len(word) > self.longest_word + 1:
            return ()
        found = {v for d in _deletes(word, 1) for v in self.less.get(d, ())}
        return tuple((v, d) for v in sorted(found) if (d := distance(word, v, 1)) <= min(1, slips(max(word, v, key=len))))

    def _near(self, word: str, most: int) -> list[tuple[str, int]]:
        """The nearest words of each language of the list within ``most`` edits, and within what the longer of the two allows."""
        around = self.within_one(word) if most == 1 else [x for x in self.around(word) if x[1] <= most]
        if not around:
            return []
        out: dict[tuple[str, int], None] = {}
        for language, ws in self.languages.items():
            own = [x for x in around if x[0] in ws]
            best = min((d for _, d in own), default=0)
            if word in self.facts:  # a nearer word of the whole list that no form here has
                best = min(best, self.facts[word].nearest.get(language, best))
            out.update((x, None) for x in own if x[1] == best)
        return list(out)

    def _joined(self, word: str, strict: bool = False) -> list[tuple[tuple[str, ...], float]]:
        """Readings of a word as two written together, stop words dropped."""
        if len(word) > 2 * self.longest_word + 6:
            return []
        best, out = 99.0, []
        for i in range(2, len(word) - 1):
            a, b = word[:i], word[i:]
            left = [((), 0.0)] if a in STOP or a in STOP_PAIRS else [((v,), float(d)) for v, d in ([(a, 0)] if a in self.vocabulary else [] if strict or len(a) < 4 else self._near(a, 1))]
            if not left:
                continue
            right = [((), 0.0)] if b in STOP or b in STOP_PAIRS else [((v,), float(d)) for v, d in ([(b, 0)] if b in self.vocabulary else [] if strict or len(b) < 4 else self._near(b, 1))]
            for lw, lc in left:
                for rw, rc in right:
                    if (lw or rw) and lc + rc <= best + 1e-9:
                        if lc + rc < best:
                            out = []
                        best = lc + rc
                        out.append((lw + rw, lc + rc))
        return out

    def _options(self, t: Token) -> tuple[tuple[tuple[str, ...], float], ...]:
        """The readings of a typed word as list words, the nearest of each language; none for a word of its own."""
        return tuple((tuple(SAME.get(x, x) for x in ws), c) for ws, c in self._readings(t))

    def _readings(self, t: Token) -> list[tuple[tuple[str, ...], float]]:
        w = t.word
        shorts = [((v,), 0.25) for v in self.longer.get(w, ())] if t.short and len(w) >= 2 else []
        if w in self.vocabulary:
            twins = [((v,), 1.0) for v, d in self.around(w) if d == 1 and not other_word(w, v)]
            foreign = [((v,), float(d)) for v, d in self._near(w, 2) if 0 < d and not other_word(w, v)]
            return list(dict.fromkeys([((w,), 0.0), *shorts, *twins, *foreign]))
        if w in self.own_words and not shorts:
            return []
        near = [((v,), float(d)) for v, d in self._near(w, 3) if not other_word(w, v)]
        joined = self._joined(w) if len(w) >= 5 else []
        every = shorts + near + joined
        if not every and t.short and len(w) >= 4:  # shortened and mistyped
            every = [((v,), 1.25) for v in self.vocabulary if len(v) > len(w) and distance(w, v[: len(w)], 1) <= 1]
        if not every and len(w) >= 7 and w not in self.own_words:  # shortened without a mark
            every = [((v,), 1.5) for v in (w[:-1], *self.longer.get(w[:-1], ())) if v in self.vocabulary]
        return list(dict.fromkeys(every))

    def _fits(self, form: list[str], typed: list[tuple[tuple[tuple[str, ...], float], ...]]) -> tuple[float, list[str]] | None:
        """(cost, form words nothing was typed for) if every typed word is one of the form."""
        best: tuple[float, list[str]] | None = None

        def go(i: int, left: list[str], cost: float) -> None:
            nonlocal best
            if best is not None and cost >= best[0] and len(left) >= len(best[1]):
                return
            if i == len(typed):
                if best is None or (len(left), cost) < (len(best[1]), best[0]):
                    best = (cost, left)
                return
            for ws, c in typed[i]:
                rest = list(left)
                try:
                    for w in ws:
                        rest.remove(w)
                except ValueError:
                    continue
                go(i + 1, rest, cost + c)

        go(0, form, 0.0)
        return best

    def _similar(self, readings: list, rest: list[Token]) -> dict[int, float]:
        """{form: Jaccard} of the forms similar to what a text reads as in a language of the list: of each word the nearest readings there.
        If every word can be read in some languages, no form of another has them all."""
        out: dict[int, float] = {}
        other = grams(rest)
        whole = [ws for ws in self.languages.values() if all(any(all(w in ws for w in x[0]) for x in options) for options in readings)]
        for words_ in whole or self.languages.values():
            found: set[str] = set(other)
            for options in readings:
                own = [x for x in options if all(w in words_ for w in x[0])] or options
                least = min(c for _, c in own)
                for ws, c in own:
                    if c == least:
                        found |= self._grams_of(ws)
            for f, j in self.candidates(frozenset(found)).items():
                out[f] = max(j, out.get(f, 0.0))
        return out

    def _checked(self, similar: dict[int, float], readings: list, odd: str | None, tail: str | None) -> tuple[list[tuple[float, int]], dict[int, float]]:
        """Of similar forms: (edits, entry) where every word is typed, and {entry: edits} where some are not."""
        full: list[tuple[float, int]] = []
        part: dict[int, float] = {}
        for f in similar:
            fit = self._fits(self.form_words[f], readings)
            if fit is None:
                continue
            cost, left = fit
            if odd is not None:
                if len(left) == 1 and not other_word(odd, left[0]):
                    most = slips(max(odd, left[0], key=len)) + 1
                    if (d := min(distance(odd, a, most) for a in (left[0], *(a for a, b in SAME.items() if b == left[0])))) <= most and d < len(left[0]) - 1:
                        full.append((cost + d, self.form_id[f]))
                continue
            if tail and any(w.startswith(tail) for w in left):
                part[self.form_id[f]] = min(part.get(self.form_id[f], 9), cost - 1)
            elif not left:
                full.append((cost, self.form_id[f]))
            else:
                part[self.form_id[f]] = min(part.get(self.form_id[f], 9), cost)
        return full, part

    def _meaning(self, text: str | None) -> tuple[str, tuple[int, ...]]:
        """('uno' | 'varios' | 'nada' | 'fuera', entries) of a text."""
        t = plain(text)
        squeezed = re.sub(r"[\W_]+", "", t)
        if len(squeezed) < 2 or squeezed.isdigit() or squeezed in self.nothing:
            return "nada", ()
        if c := code(t):
            near = self.candidates(code_set(c))
            best = max(near.values(), default=0.0)
            ids = {self.form_id[f] for f, j in near.items() if j == best}
            return ("fuera" if not ids else "uno" if best == 1 else "varios"), tuple(sorted(ids))
        words = [x for x in tokens(_CODE.sub(" ", re.sub(r"\([^()]*\)\s*$", " ", t) if "(" in t else t)) if x.word not in STOP and x.word not in STOP_PAIRS]
        typed = [x for x in words if x.word not in ABOUT or x.word in self.vocabulary]
        if not typed:
            return "nada", ()
        if sum(len(x.word) > 4 for x in typed) > self.most_words:
            return "fuera", ()  # every such word would have to be one of the form
        readings: list = []
        tail, odd = None, None
        slipped: list[tuple[str, tuple]] = []  # words that resemble none of the list whole, with what they are read as
        for i, x in enumerate(typed):
            if len(x.word) <= 3 and x.word not in self.vocabulary:
                if i == len(typed) - 1 and x.short and not any(s.startswith(x.word) for s in LITTLE):
                    tail = x.word
                elif len(x.word) == 3 and min(distance(x.word, s, 1) for s in LITTLE) > 1 and (near := self._near(x.word, 1)):
                    readings.append(tuple(((SAME.get(v, v),), float(d)) for v, d in near))
                elif x.short and len(x.word) == 3:
                    readings.append(self.options(x) or ((), 0.0))
                continue  # a slip of a stop word
            if len(x.word) == 4 and x.word not in self.vocabulary and not self.options(x) and any(distance(x.word, s, 1) <= 1 for s in STOP):
                continue
            o = self.options(x)
            if not o:
                if min((distance(squeezed, p, 1) for p in self.nothing if len(p) > 4), default=9) <= 1:
                    return "nada", ()
                if odd is not None or x.word in self.own_words or len(typed) < 2:
                    return "fuera", ()
                odd = x.word  # it may still be the one word a form lacks, badly mistyped
                continue
            readings.append(o)
            if x.word not in self.vocabulary and not self.around(x.word):
                slipped.append((x.word, o))
        readings = [r for r in readings if r and r[0]]
        if not readings:
            return "nada" if tail is None and odd is None else "fuera", ()  # an unknown word says something
        rest = [Token(w, short) for w, short in ((odd, False), (tail, True)) if w]
        full, part = self._checked(self._similar(readings, rest), readings, odd, tail)
        if not full:  # what stays open is similar as typed
            full, part = self._checked(self.candidates(grams(typed), self.open), readings, odd, tail)
        if not full and not part and odd is None and tail is None and len(readings) > 1:
            # one word may be read as another than it is: it may be the one word a form lacks, badly mistyped
            for word, options in slipped:
                others = [r for r in readings if r is not options]
                if len(others) == len(readings) - 1:
                    full += self._checked(self._similar(others, [Token(word, False)]), others, word, None)[0]
        if full:
            # as read, every word of these is typed: their Jaccard value is 1, and the fewest edits are best
            least = min(full)[0]
            ids = {k for c, k in full if c <= least + 1e-9}
            return ("uno" if len(ids) == 1 else "varios"), tuple(sorted(ids))
        if part:
            if tail:
                least = min(part.values())
                part = {k: v for k, v in part.items() if v <= least + 0.5}
            return "varios", tuple(sorted(part))
        return "fuera", ()


def _deletes(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out = level_ = {word}
    for _ in range(min(most, len(word) - 1)):
        level_ = {w[:i] + w[i + 1 :] for w in level_ for i in range(len(w))}
        out = out | level_
    return out


# ------------------------------------------------------------------------------------------------ rows


@dataclass(frozen=True)
class Listed:
    """One entry of the list: key, code, snomed code, forms."""

    key: int
    cie10: str
    snomed: str
    names: tuple[tuple[str, str], ...]  # (language, plain name)


def read_list(terms: DataFrame) -> list[Listed]:
    """The list; nulls in any field are left out of it. The caller checks its length."""
    out = []
    for r in terms.select("termino_id", "nombre", "cie10", "snomed_ct", "snomed_termino", "sinonimos").distinct().collect():
        if r.termino_id is None:
            continue
        names = [("es", n) for n in (r.nombre, *(r.sinonimos or ()))] + [("en", r.snomed_termino and re.sub(r"\s*\([^()]*\)\s*$", "", r.snomed_termino))]
        out.append(Listed(r.termino_id, r.cie10 or "", r.snomed_ct or "", tuple((lang, plain(n)) for lang, n in names if n)))
    return out


Meaning = tuple[str, tuple[int, ...]]


def decide(forms: Forms, by_snomed: dict[str, frozenset[int]], name: str | None, cie: str | None, snomed: str | None, term: str | None) -> tuple[str, int | None]:
    """(verdict, entry) of the fields of one entry, with the list in memory."""
    named = forms.meaning(name)
    if named[0] in ("uno", "fuera"):
        return weigh(named, "", None, (), ("nada", ()), ())
    c = code(cie)
    return weigh(named, c, forms.codes.get(c), forms.category.get(c, ()) if len(c) == 3 else (), forms.meaning(term), by_snomed.get((snomed or "").strip(), ()))


def weigh(named: Meaning, c: str, exact: int | None, category: Iterable[int], term: Meaning, snomed: Iterable[int]) -> tuple[str, int | None]:
    """(verdict, entry): ``nombre`` by the name, ``otros`` by the other fields, else ``abierto``, ``nada`` or ``fuera``.

    named, term: what the two texts mean; c: the code, with the entry that has it and the entries of the category that it is; snomed: the
    entries with that code.
    """
    kind, ids = named
    if kind == "uno":
        return "nombre", ids[0]
    if kind == "fuera":
        return "fuera", None
    votes: Counter = Counter()
    contradicted = False
    if exact is not None:
        votes[exact] += 4
    elif category:
        for k in category:
            votes[k] += 1
    elif c:
        contradicted = True
    tk, tids = term
    if tk == "uno":
        votes[tids[0]] += 5
    elif tk == "varios":
        for k in tids:
            votes[k] += 2
    elif tk == "fuera":
        contradicted = True
    for k in snomed:
        votes[k] += 2
    if kind == "varios":
        inside = {k: v for k, v in votes.items() if k in ids}
        if not inside:
            return ("nombre", ids[0]) if len(ids) == 1 and not votes and not contradicted else ("abierto", None)
        votes = Counter(inside)
    elif contradicted and tk == "fuera":
        return "fuera", None
    elif contradicted and tk != "uno":
        return "abierto", None
    if not votes:
        return kind if kind == "nada" else "abierto", None
    (best, n), *rest = votes.most_common(2)
    if rest and rest[0][1] == n or n < 2 and len(votes) > 1:
        return "abierto", None
    return "otros", best


def corpus_words(entries: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """kind (w: a word, g: a trigram), w, keys and texts: how many keys and distinct texts have it, over all rows. A key counts once with a
    text, however often it is delivered; partial sums leave each task."""
    texts = None
    for c in columns:
        one = entries.select(F.col(key).alias("k"), F.trim(c).alias("t")).filter("t is not null and t <> ''")
        texts = one if texts is None else texts.unionByName(one)
    texts = texts.distinct().groupBy("t").agg(F.count("*").alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for pdf in batches:
            for t, n in zip(pdf["t"], pdf["n"]):
                ws = tokens(plain(t))
                dotted = t.endswith(".")
                for k in {("w", x.word) for x in ws if len(x.word) > 2 and (not x.short or x is ws[-1] and not dotted)} | {("g", g) for g in grams(ws)}:
                    c[k][0] += n
                    c[k][1] += 1
            if len(c) > 200_000:
                yield frame(c)
                c.clear()
        yield frame(c)

    def frame(c: dict) -> pd.DataFrame:
        return pd.DataFrame([(k, w, *n) for (k, w), n in c.items()], columns=["kind", "w", "keys", "texts"])

    return texts.mapInPandas(count, "kind string, w string, keys long, texts long").groupBy("kind", "w").agg(F.sum("keys").alias("keys"), F.sum("texts").alias("texts"))


def evidence(words: DataFrame, entries: list[tuple[int, str, list[tuple[str, str]]]]) -> tuple[dict[str, int], dict[str, tuple[int, int]]]:
    """({trigram of the list: texts}, {word: (keys, texts)} of the list's words and of words of their own) from ``corpus_words``, read twice.

    Only what concerns the list arrives: its own trigrams and words, and words of their own, each near a list word and at least SHARE as
    frequent. Nothing is cut by its share of the corpus, so texts that have nothing to do with the list change nothing.
    """
    bare = Forms(entries)
    known = words.sparkSession.createDataFrame([("w", w) for w in bare.vocabulary] + [("g", g) for g in bare.rank if g[0] != "#"], "kind string, w string")
    listed = words.join(F.broadcast(known), ["kind", "w"]).collect()  # as many rows at most as the list has words and trigrams
    counts = {r.w: (r["keys"], r.texts) for r in listed if r.kind == "w"}

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Forms(entries)
        for pdf in batches:
            out = [(w, k, n) for w, k, n in zip(pdf["w"], pdf["keys"], pdf["texts"]) if forms.around(w) and forms.own_word(w, k, n, counts.get)]
            yield pd.DataFrame(out, columns=["w", "keys", "texts"])

    often = words.filter((F.col("kind") == "w") & (F.col("keys") >= OFTEN) & (F.col("texts") >= TEXTS)).select("w", "keys", "texts")
    found = {r.w: (r["keys"], r.texts) for r in often.mapInPandas(own, "w string, keys long, texts long").collect()}
    return {r.w: r.texts for r in listed if r.kind == "g"}, counts | found


def resolve(entries: DataFrame, terms: DataFrame, key: str = "entrada_id", similar: float = SIMILAR, most: int = MOST_FORMS) -> DataFrame:
    """key, termino_id (null if there is none) and veredicto of every entry, once an entry.

    ``nombre``: the name means the entry; ``otros``: the other fields decided; ``abierto``: several stay open; ``nada``: nothing says
    anything; ``fuera``: not on the list. Rows without key count like any other; repeated rows count once; extra columns are dropped.
    A list of more than ``most`` forms does not travel with the tasks: ``resolve_shuffled``.
    """
    forms_ = terms.select(F.sum(F.size(F.coalesce("sinonimos", F.array())) + 2)).first()[0] or 0
    if forms_ > most:
        return resolve_shuffled(entries, terms, key)
    listed = read_list(terms)
    entries_ = [(x.key, x.cie10, list(x.names)) for x in listed]
    counts, words = evidence(cut(corpus_words(entries, key, ("nombre", "snomed_termino"))), entries_)
    snomed: dict[str, set[int]] = defaultdict(set)
    for x in listed:
        if x.snomed:
            snomed[x.snomed].add(x.key)
    by_snomed = {k: frozenset(v) for k, v in snomed.items()}
    schema = _resolved(entries, key)
    made = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = _at_hand(made, lambda: Forms(entries_, counts, words, similar))
        for pdf in batches:
            out = []
            for k, *fields in pdf.itertuples(index=False):
                fields = [f if isinstance(f, str) else None for f in fields]
                verdict, entry = decide(forms, by_snomed, *fields)
                out.append((k, entry, verdict))
            yield pd.DataFrame(out, columns=schema.names).astype({"termino_id": "Int32"})

    return spread(entries.select(key, "nombre", "cie10", "snomed_ct", "snomed_termino"), key).mapInPandas(run, schema).distinct()


_HELD: dict[str, Forms] = {}


def _at_hand(made: str, make) -> Forms:
    """The list of one call of ``resolve``, kept by a Python worker from task to task with what it has read; the one before is dropped."""
    if made not in _HELD:
        _HELD.clear()
        _HELD[made] = make()
    return _HELD[made]


def _resolved(entries: DataFrame, key: str) -> T.StructType:
    return T.StructType([entries.schema[key], T.StructField("termino_id", T.IntegerType()), T.StructField("veredicto", T.StringType())])


# ------------------------------------------------------------------------------------------------ lists of any length


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """Rows that ``each`` gives for every row."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for row in pdf.itertuples(index=False) for r in each(*row)], columns=names)

    return df.mapInPandas(run, schema)


def form_rows(terms: DataFrame) -> DataFrame:
    """k, lang, name (plain), form (its words): a row a form of the list."""
    english = F.regexp_replace("snomed_termino", r"\s*\([^()]*\)\s*$", "")
    es = F.transform(F.concat(F.array("nombre"), F.coalesce("sinonimos", F.array())), lambda n: F.struct(F.lit("es").alias("lang"), n.alias("n")))
    each = terms.filter("termino_id is not null").select(F.col("termino_id").alias("k"), F.explode(F.array_append(es, F.struct(F.lit("en").alias("lang"), english.alias("n")))).alias("f"))

    def words_of(k, lang, n):
        name = plain(n)
        form = " ".join(SAME.get(t.word, t.word) for t in tokens(name) if t.word not in STOP)
        return [(k, lang, name, form)] if form else []

    return _mapped(each.select("k", "f.lang", "f.n").filter("n is not null").distinct(), "k int, lang string, name string, form string", words_of).distinct()


def word_facts(words: DataFrame, listed: DataFrame) -> DataFrame:
    """w, listed, own, nearest ({language: edits}) of every typed word of ``corpus_words`` (w, keys, texts) that resembles a word of ``listed``
    (v, lang). Words so near share one with letters left out, which is what is joined on."""
    left_out = lambda w: [(w, d) for d in _deletes(w, slips(w + "xxx"))]
    typed = _mapped(words.select("w"), "w string, d string", left_out)
    known = _mapped(listed.select("v").distinct(), "v string, d string", left_out)

    def within(w, v):
        most = slips(max(w, v, key=len))
        return [(w, v, d)] if (d := distance(w, v, most)) <= most else []

    near = _mapped(typed.join(known, "d").select("w", "v").distinct(), "w string, v string, edits int", within)
    count = words.select(F.col("w").alias("v"), F.col("keys").alias("vk"), F.col("texts").alias("vt"))
    near = near.join(count, "v", "left").fillna(0, ["vk", "vt"])
    least = near.groupBy("w").agg(F.min("edits").alias("least"), F.max("vk").alias("vk"))
    nearest = near.join(listed, "v").groupBy("w", "lang").agg(F.min("edits").alias("e")).groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("lang", "e"))).alias("nearest"))
    at_least = near.join(least.select("w", "least"), "w").filter("edits = least").groupBy("w").agg(F.max("vt").alias("vt"))
    # two list words written together are no word of its own
    halves = _mapped(words.filter(F.col("keys") >= OFTEN).select("w"), "w string, a string, b string", lambda w: [(w, w[:i], w[i:]) for i in range(2, len(w) - 1)])
    part = listed.select(F.col("v").alias("p")).distinct().unionByName(listed.sparkSession.createDataFrame([(x,) for x in STOP | STOP_PAIRS], "p string")).distinct()
    joined = halves.join(part.withColumnRenamed("p", "a"), "a").join(part.withColumnRenamed("p", "b"), "b").select("w").distinct().withColumn("joined", F.lit(True))
    found = words.join(least, "w").join(nearest, "w").join(at_least, "w").join(joined, "w", "left")
    found = found.join(listed.select(F.col("v").alias("w")).distinct().withColumn("listed", F.lit(True)), "w", "left").fillna(False, ["listed", "joined"])
    often = (F.col("keys") >= OFTEN) & (F.col("texts") >= TEXTS) & (F.length("w") > 3) & ~F.col("listed") & ~F.col("joined")
    share = F.when(F.col("least") == 1, ONE_EDIT).otherwise(SHARE)
    own = often & ((F.col("keys") >= SHARE * F.col("vk")) | ((F.col("texts") > TEXTS) & (F.col("texts") >= share * F.col("vt"))))
    return found.select("w", "listed", own.alias("own"), "nearest")


def meanings(texts: DataFrame, forms: DataFrame, facts: DataFrame) -> DataFrame:
    """t, kind, ids: what every text (t) means by ``forms`` (``form_rows``): the similarity join as a plan, then the check with the similar forms
    of the text and the ``facts`` of its words. Texts that are codes are not answered here."""
    named = forms.groupBy("form").agg(F.collect_set(F.struct("k", "lang", "name")).alias("of"))
    pairs = similarity_join(texts.select(F.col("t").alias("l"), F.col("t").alias("text")), named.select(F.col("form").alias("r"), F.col("form").alias("text")), OPEN, best=False)
    some = pairs.join(named, pairs.r == named.form).groupBy(F.col("l").alias("t")).agg(F.flatten(F.collect_list("of")).alias("of"))
    own = _mapped(texts.select("t"), "t string, w string", lambda t: {(t, x.word) for x in tokens(plain(t))})
    known = own.join(facts, "w").groupBy("t").agg(F.collect_list(F.struct("w", "listed", "own", F.map_entries("nearest").alias("nearest"))).alias("facts"))
    both = texts.select("t").join(some, "t", "left").join(known, "t", "left")

    def check(t, of, facts):
        by: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for f in () if of is None else of:
            by[f["k"]].append((f["lang"], f["name"]))
        told = {} if facts is None else {f["w"]: Fact(f["listed"], f["own"], {e["key"]: e["value"] for e in f["nearest"]}) for f in facts}
        kind, ids = Forms([(k, "", sorted(names)) for k, names in sorted(by.items())], facts=told).meaning(t)
        return [(t, kind, list(ids))]

    return _mapped(both, "t string, kind string, ids array<int>", check)


def resolve_shuffled(entries: DataFrame, terms: DataFrame, key: str = "entrada_id") -> DataFrame:
    """``resolve`` for a list of any length: neither list nor texts are ever held whole, every step is a join of distinct texts, words or codes.

    The same join and check, but that a word both shortened and mistyped, or written together with another and mistyped, is read only as
    words of the forms that are similar to the text as typed.
    """
    forms = cut(form_rows(terms))
    words = cut(corpus_words(entries, key, ("nombre", "snomed_termino")).filter("kind = 'w'"))
    listed = _mapped(forms.select("lang", "form"), "v string, lang string", lambda lang, form: [(w, lang) for w in form.split()]).distinct()
    own = entries.select(key, "nombre", "cie10", "snomed_ct", "snomed_termino").distinct()
    texts = own.select(F.col("nombre").alias("t")).unionByName(own.select(F.col("snomed_termino").alias("t"))).filter("t is not null").distinct()
    meant = cut(meanings(texts, forms, word_facts(words, listed)))
    # codes, alone in a field or typed as a name, by those of the list and their categories
    coded = terms.filter("termino_id is not null and cie10 is not null").select(F.upper("cie10").alias("c"), F.col("termino_id").alias("k")).distinct()
    exact = coded.groupBy("c").agg(F.max("k").alias("exact"))
    category = coded.groupBy(F.substring("c", 1, 3).alias("c")).agg(F.sort_array(F.collect_set("k")).alias("category"))
    written = own.select(F.col("cie10").alias("t")).unionByName(texts).filter("t is not null").distinct()
    codes = _mapped(written, "t string, c string", lambda t: [(t, c)] if (c := code(t)) else []).join(exact, "c", "left").join(category, "c", "left")
    snomed = terms.filter("termino_id is not null and snomed_ct is not null and snomed_ct <> ''").groupBy("snomed_ct").agg(F.sort_array(F.collect_set("termino_id")).alias("snomed"))

    def named(as_: str) -> DataFrame:
        """What a text means, one that is a code included."""
        by_code = F.when(F.col("c").isNull(), F.struct("kind", "ids")).when(F.col("exact").isNotNull(), F.struct(F.lit("uno").alias("kind"), F.array("exact").alias("ids")))
        by_code = by_code.when((F.length("c") == 3) & F.col("category").isNotNull(), F.struct(F.lit("varios").alias("kind"), F.col("category").alias("ids"))).otherwise(F.struct(F.lit("fuera").alias("kind"), F.array().cast("array<int>").alias("ids")))
        nothing = F.length(F.regexp_replace("t", r"[\s\p{P}]", "")) < 2
        return meant.join(codes, "t", "left").select("t", F.when(nothing, F.struct("kind", "ids")).otherwise(by_code).alias(as_))

    rows = own.join(named("n").withColumnRenamed("t", "nombre"), "nombre", "left").join(named("s").withColumnRenamed("t", "snomed_termino"), "snomed_termino", "left")
    rows = rows.join(codes.withColumnRenamed("t", "cie10"), "cie10", "left").join(snomed.withColumn("snomed_ct", F.trim("snomed_ct")), "snomed_ct", "left")
    rows = rows.select(key, F.col("n.kind").alias("nk"), F.col("n.ids").alias("ni"), F.col("s.kind").alias("sk"), F.col("s.ids").alias("si"), "c", "exact", F.when(F.length("c") == 3, F.col("category")).alias("category"), "snomed")
    schema = _resolved(entries, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = lambda x: () if x is None else tuple(int(i) for i in x)
        for pdf in batches:
            out = []
            for k, nk, ni, sk, si, c, exact, category, snomed in pdf.itertuples(index=False):
                c = c if isinstance(c, str) else ""
                verdict, entry = weigh((nk if isinstance(nk, str) else "nada", ids(ni)), c, None if exact is None or exact != exact else int(exact), ids(category), (sk if isinstance(sk, str) else "nada", ids(si)), ids(snomed))
                out.append((k, entry, verdict))
            yield pd.DataFrame(out, columns=schema.names).astype({"termino_id": "Int32"})

    return rows.mapInPandas(run, schema).distinct()


def similarity_join(left: DataFrame, right: DataFrame, similar: float = SIMILAR, best: bool = True) -> DataFrame:
    """l, r, jaccard of the texts of ``left`` (l, text) and ``right`` (r, text) at least ``similar``, all of them or the best of each l.

    The prefix-filter join as a plan: trigrams ranked by how many texts of either side have them, prefixes joined on the trigram, length
    and positional filters, exact verification of each pair once. Only ids and positions meet on a trigram, and one that more than HOT
    texts have is split. Repeated texts are joined once. Texts without a word join nothing; of equally good
    partners the smallest r is the best.
    """

    def sets(df: DataFrame, key: str) -> DataFrame:
        schema = T.StructType([df.schema[key], T.StructField("g", T.ArrayType(T.StringType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(k, sorted(grams(tokens(plain(t))))) for k, t in zip(pdf[key], pdf["text"])], columns=[key, "g"])

        return df.select(key, "text").mapInPandas(run, schema).filter(F.size("g") > 0)

    a, b = cut(sets(left, "l")), cut(sets(right, "r"))
    seen = a.select(F.explode("g").alias("g")).unionByName(b.select(F.explode("g").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        """key, n, pos, t and how many parts the trigram t is split into."""
        ranked = df.select(key, F.explode("g").alias("g"), F.size("g").alias("n")).join(seen, "g")
        whole = ranked.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
        k = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1
        return whole.select(key, "n", F.posexplode(F.slice("o", F.lit(1), k.cast("int"))).alias("pos", "x")).select(key, "n", "pos", F.col("x.g").alias("t"), F.ceil(F.col("x.df") / HOT).cast("int").alias("__parts"))

    # a trigram that many have is split: each left row meets one part of it, in which every right row is
    p = prefixes(a, "l").select("l", F.col("n").alias("ln"), F.col("pos").alias("lp"), "t", F.pmod(F.xxhash64("l"), F.col("__parts")).cast("int").alias("__part"))
    q = prefixes(b, "r").select("r", F.col("n").alias("rn"), F.col("pos").alias("rp"), "t", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    least = F.ceil(similar / (1 + similar) * (F.col("ln") + F.col("rn")) - 1e-9)
    room = 1 + F.least(F.col("ln") - F.col("lp") - 1, F.col("rn") - F.col("rp") - 1)
    met = p.join(q, ["t", "__part"]).filter((F.col("rn") >= similar * F.col("ln")) & (F.col("ln") >= similar * F.col("rn")))
    # a pair that can be similar is so by its first common prefix trigram, which is that with the most room
    kept = met.groupBy("l", "r").agg(F.max(F.when(room >= least, 1).otherwise(0)).alias("ok")).filter("ok = 1").select("l", "r")
    both = kept.join(a.withColumnRenamed("g", "lg"), "l").join(b.withColumnRenamed("g", "rg"), "r").withColumn("n", F.size(F.array_intersect("lg", "rg")))
    pairs = both.select("l", "r", (F.col("n") / (F.size("lg") + F.size("rg") - F.col("n"))).alias("jaccard")).filter(F.col("jaccard") >= similar)
    if not best:
        return pairs
    top = pairs.groupBy("l").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "r")).alias("m"))
    return top.select("l", F.col("m.r").alias("r"), (-F.col("m.j")).alias("jaccard"))
