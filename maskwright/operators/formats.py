"""Values of formats and planted documents as SQL text, which Catalyst runs in the JVM and other engines run as well.

A format is literals and tokens; each token is one or more choices of fixed strings. A choice is drawn by sha256 of a seed
and the choice's number, so a value depends on nothing but its seed, on any machine and in any order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import MONTHS

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Token -> its characters. A number after one of these is a count.
COUNTED = {"d": DIGITS, "D": DIGITS[1:], "L": LOWER.upper(), "l": LOWER, "x": DIGITS + "abcdef", "w": LOWER.upper() + LOWER + DIGITS, "h": DIGITS + "ABCDEF"}
#: Token -> regular expression of what it stands for.
SINGLE = {"yyyy": "(?:19|20)[0-9]{2}", "yy": "[0-9]{2}", "mm": "(?:0[1-9]|1[0-2])", "dd": "(?:0[1-9]|1[0-9]|2[0-8])", "Month": "(?:" + "|".join(MONTHS) + ")", "Mon": "(?:" + "|".join(m[:3] for m in MONTHS) + ")", "do": "(?:[1-9]|1[0-9]|2[0-8])(?:st|nd|rd|th)", "fn": "[A-Z][a-z]+", "ln": "[A-Z][a-z]+", "fi": "[A-Z]", "c": "[A-Z0-9]", "a": "[A-Za-z]", "n": "[1-9][0-9]*"}
TOKEN = re.compile(r"\{(?:([dDLlxwh])([0-9]*)|(yyyy|yy|mm|dd|Month|Mon|do|fn|ln|fi|c|a|n))\}")
GIVEN = "Adela Anton Birgit Bruno Carla Cedric Dagmar Dorian Edda Elias Fabia Fergus Gesa Gideon Helma Hugo".split()
FAMILY = "Achterberg Balogun Cardwell Dahlgren Ellingson Farkas Gerritsen Holloway Isakov Jankowski Kettering Lundberg Mahoney Nakagawa Oyelaran Pemberton Rose Page Marks Bell".split()  # the last four are words as well


def ordinal(day: int) -> str:
    return f"{day}{'th' if 11 <= day <= 13 else {1: 'st', 2: 'nd', 3: 'rd'}.get(day % 10, 'th')}"


CHOICES = {"yyyy": [str(y) for y in range(1930, 2025)], "yy": [f"{y:02}" for y in range(100)], "mm": [f"{m:02}" for m in range(1, 13)], "dd": [f"{d:02}" for d in range(1, 29)], "Month": MONTHS, "Mon": [m[:3] for m in MONTHS], "do": [ordinal(d) for d in range(1, 29)], "fn": GIVEN, "ln": FAMILY, "fi": list(LOWER.upper()), "c": list(LOWER.upper() + DIGITS), "a": list(LOWER.upper() + LOWER), "n": [str(n) for n in range(1, 200)]}


def tokens_of(pattern: str) -> Iterator[tuple[str, int | None]]:
    """(literal, None), or (token, count), of a pattern such as "{L2}-{d6}"."""
    at = 0
    for m in TOKEN.finditer(pattern):
        if m.start() > at:
            yield pattern[at : m.start()], None
        yield (m[1], int(m[2] or 1)) if m[1] else (m[3], 1)
        at = m.end()
    if at < len(pattern):
        yield pattern[at:], None


def format_regex(pattern: str) -> str:
    """The regular expression of a format, in a dialect that Catalyst, DuckDB and Python share."""
    kinds = {"d": "[0-9]", "D": "[1-9]", "L": "[A-Z]", "l": "[a-z]", "x": "[0-9a-f]", "w": "[A-Za-z0-9]", "h": "[0-9A-F]"}
    return "^" + "".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", t) if n is None else f"{kinds[t]}{{{n}}}" if t in kinds else SINGLE[t] for t, n in tokens_of(pattern)) + "$"


def pieces_of(pattern: str) -> Iterator[str | list[str]]:
    """Literals, and the choices of each drawn part."""
    for t, n in tokens_of(pattern):
        if n is None:
            yield t
        else:
            for _ in range(n):
                yield list(COUNTED[t]) if t in COUNTED else CHOICES[t]


def drawn(n: int, seed: str, k: int | str) -> int:
    return int(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:8], 16) % n


def draw_sql(n: int | str, seed: str, k: int | str, spark: bool = True) -> str:
    """A whole number below n by sha256 of SQL text seed and the draw's name k."""
    key = f"concat({seed}, '|{k}')"
    return f"(CAST(conv(substr(sha2({key}, 256), 1, 8), 16, 10) AS BIGINT) % {n})" if spark else f"(('0x' || left(sha256({key}), 8))::BIGINT % {n})"


def pick_sql(choices: list[str], draw: str) -> str:
    """The choice that a draw gives: a substring of all of them, padded to one width."""
    width = max(map(len, choices))
    text = "".join(c.ljust(width) for c in choices).replace("'", "''")
    part = f"substr('{text}', CAST({draw} AS INT) * {width} + 1, {width})"
    return part if all(len(c) == width for c in choices) else f"rtrim({part})"


def sample_format(pattern: str, seed: str) -> str:
    """A value of a format, fixed by seed."""
    return "".join(p if isinstance(p, str) else p[drawn(len(p), seed, k)] for k, p in enumerate(pieces_of(pattern)))


def format_sql(pattern: str, seed: str, spark: bool = True) -> str:
    """SQL of sample_format() for a seed given as SQL text."""
    parts = ["'" + p.replace("'", "''") + "'" if isinstance(p, str) else pick_sql(p, draw_sql(len(p), seed, k, spark)) for k, p in enumerate(pieces_of(pattern))]
    return f"concat({', '.join(parts)})"


def format_column(pattern: str, seed: Column) -> Column:
    """sample_format() of each row's seed, in Catalyst."""
    draw = lambda n, k: F.conv(F.substr(F.sha2(F.concat(seed, F.lit(f"|{k}")), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % n
    pick = lambda p, k: F.element_at(F.array(*map(F.lit, p)), (draw(len(p), k) + 1).cast("int"))
    return F.concat(*[F.lit(p) if isinstance(p, str) else pick(p, k) for k, p in enumerate(pieces_of(pattern))])


def infer_format(example: str) -> str:
    """A format that an example belongs to: runs of digits and letters become counted tokens."""
    return re.sub("[0-9]+|[A-Z]+|[a-z]+", lambda m: "{" + ("d" if m[0][0].isdigit() else "L" if m[0][0].isupper() else "l") + str(len(m[0])) + "}", example)


#: Labels that need a choice of test formats, and how many at least.
LEAST_FORMATS = 3


def novel(test: dict[str, str], train: list[str], draws: int = 200, labels: dict[str, str] | None = None, generators: dict[str, list] | None = None) -> dict[str, str]:
    """Of test formats by name, why one isn't new: a value fails its own expression, fits a training format, or is like a
    value that a generator (seed -> value) of its label makes; and labels with fewer than LEAST_FORMATS formats."""
    known, out = [re.compile(format_regex(t)) for t in train], {}
    for name, pattern in test.items():
        own = re.compile(format_regex(pattern))
        for i in range(draws):
            v = sample_format(pattern, f"{name}:{i}")
            if not own.match(v):
                out[name] = f"{v} isn't of its own format"
                break
            if any(k.match(v) for k in known):
                out[name] = f"{v} is of a training format"
                break
        for make in (generators or {}).get((labels or {}).get(name, ""), []):
            if made := next((v for i in range(10 * draws) if own.match(v := make(f"{name}:{i}"))), None):
                out.setdefault(name, f"{made} is a training generator's")
    for label in sorted(set((labels or {}).values())):
        n = sum(of == label for of in labels.values())
        if n < LEAST_FORMATS:
            out[label] = f"{n} formats of {LEAST_FORMATS}"
    return out
