"""Where a pattern can begin: word starts of a text by their first letters, and the first letters that a pattern allows.

Patterns that begin at a word boundary are tried at the words whose first letters fit, instead of at every position of the
text. Letters are compared in lower case and digits as one, so the places are a superset of those where a match begins.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

#: Letters of a word that are looked at.
DEPTH = 3
#: Characters of a set that are told apart; a larger one may be anything.
MOST = 40
WORD_START = re.compile(r"\b\w")


DIGITS_AS_ONE = str.maketrans("123456789", "0" * 9)


def plain(s: str) -> str:
    return s.lower().translate(DIGITS_AS_ONE)


class Paths:
    """Prefixes of what a pattern matches; `done` ones may go on in any way."""

    def __init__(self, going: set[str], done: set[str]):
        self.going, self.done = going, done

    def then(self, letters: set[str] | None) -> Paths:
        if letters is None:
            return Paths(set(), self.done | self.going)
        longer = {g + x for g in self.going for x in letters}
        return Paths({p for p in longer if len(p) < DEPTH}, self.done | {p for p in longer if len(p) >= DEPTH})

    def __or__(self, other: Paths) -> Paths:
        return Paths(self.going | other.going, self.done | other.done)


def letters_of(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            out.add(plain(chr(value)))
        elif kind is c.RANGE and value[1] - value[0] < MOST:
            out |= {plain(chr(x)) for x in range(value[0], value[1] + 1)}
        elif kind is c.CATEGORY and value is c.CATEGORY_DIGIT:
            out.add("0")
        else:
            return None
    return out if len(out) <= MOST and all(len(x) == 1 for x in out) else None


def walk(parsed, paths: Paths) -> Paths:
    for kind, value in parsed:
        if not paths.going:
            return paths
        if kind is c.LITERAL:
            paths = paths.then({plain(chr(value))})
        elif kind is c.IN:
            paths = paths.then(letters_of(value))
        elif kind is c.BRANCH:
            paths = sum_of([walk(b, paths) for b in value[1]])
        elif kind is c.SUBPATTERN:
            paths = walk(value[3], paths)
        elif kind is c.MAX_REPEAT:
            least, most, item = value
            once = walk(item, paths)
            for _ in range(max(least, 1) - 1):
                once = walk(item, once)
            more = once if most == max(least, 1) else once.then(None)
            paths = more if least else more | paths
        elif kind is not c.AT:
            paths = paths.then(None)
    return paths


def sum_of(all_: list[Paths]) -> Paths:
    out = all_[0]
    for p in all_[1:]:
        out = out | p
    return out


def bounded(parsed) -> bool:
    """Whether every match begins at a word boundary."""
    for kind, value in parsed:
        if kind is c.AT:
            return value is c.AT_BOUNDARY
        if kind is c.SUBPATTERN:
            return bounded(value[3])
        if kind is c.BRANCH:
            return all(bounded(b) for b in value[1])
        return False
    return False


def prefixes(pattern: str) -> frozenset[str] | None:
    """First letters of all matches of a pattern; None where they may be anything or needn't begin a word."""
    parsed = parser.parse(pattern)
    if not bounded(parsed):
        return None
    paths = walk(parsed, Paths({""}, set()))
    found = paths.going | paths.done
    for n in range(DEPTH - 1, 0, -1):
        if len(found) > MOST:
            found = {p[:n] for p in found}
    return frozenset(found) if all(p and (p[0].isalnum() or p[0] == "_") for p in found) else None


def capital(pattern: str) -> bool:
    """Whether every match begins with one of A-Z, by the pattern's first item."""

    def first(parsed) -> bool:
        for kind, value in parsed:
            if kind is c.AT:
                continue
            if kind is c.LITERAL:
                return "A" <= chr(value) <= "Z"
            if kind is c.IN:
                return all((k is c.LITERAL and "A" <= chr(v) <= "Z") or (k is c.RANGE and "A" <= chr(v[0]) and chr(v[1]) <= "Z") for k, v in value)
            if kind is c.BRANCH:
                return all(first(b) for b in value[1])
            if kind is c.SUBPATTERN:
                return not value[1] & re.IGNORECASE and first(value[3])
            return kind is c.MAX_REPEAT and value[0] > 0 and first(value[2])
        return False

    parsed = parser.parse(pattern)
    return not parsed.state.flags & re.IGNORECASE and first(parsed)


#: First letters that a rule looks for, and whether the first is a capital.
Heads = tuple[frozenset[str], bool]
#: Numbers of the heads that rules look for; rules that share one share its places.
WANTED: dict[Heads, int] = {}
#: The numbers of the heads that a word of these first letters fits, as far as such words were met; emptied where it grows large.
FITS: dict[str, tuple[int, ...]] = {}
MOST_FITS = 100_000


def wanted(heads: frozenset[str], capitals: bool) -> int:
    """The number of the places in later indexes where words begin so."""
    if (heads, capitals) not in WANTED:
        WANTED[heads, capitals] = len(WANTED)
        FITS.clear()
    return WANTED[heads, capitals]


def fitting(letters: str) -> tuple[int, ...]:
    if len(FITS) >= MOST_FITS:
        FITS.clear()
    low, large = letters.lower(), "A" <= letters[0] <= "Z"
    FITS[letters] = found = tuple(i for (heads, capitals), i in WANTED.items() if (large or not capitals) and any(low[:n] in heads for n in range(1, DEPTH + 1)))
    return found


class Index:
    """Word starts of a text by the heads that they fit."""

    def __init__(self, text: str, low: str):
        self.at: list[list[int]] = [[] for _ in WANTED]
        key, at = low.translate(DIGITS_AS_ONE), self.at
        for m in WORD_START.finditer(text):
            p = m.start()
            letters = (text[p] if "A" <= text[p] <= "Z" else key[p]) + key[p + 1 : p + DEPTH]
            fits = FITS.get(letters)
            for i in fitting(letters) if fits is None else fits:
                at[i].append(p)
