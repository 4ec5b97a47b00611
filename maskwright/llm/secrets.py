"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

Method of the second part: the cheapest way to guess a value is found by dynamic programming over its segmentations into
dictionary words, dates, hosts, repeats, keyboard walks and brute-force spans (each step adds the logarithm of a segment's
guesses). Values whose cheapest guess is dear enough, and that mix letters with digits or signs, are secrets.

The dictionary ranks WORDS, then the whole words of the tokenizer's vocabulary, and beside them the words of all texts by the number of
rows that hold them outside of the values in question, from LEAST_ROWS rows and down to about MOST_WORDS.

Defined results: null text counts as empty and has no spans; offsets are code points, ends exclusive; texts are scanned
whole. Rows are mapped one by one but for the counts of words; empty tables and extra columns change nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import TABLES, begin_task, cut, map_rows, small_batches, table, texts_of

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 or more: shorter runs would be dropped, and a run holds one match.
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")

#: Wider contexts, and the value after them; a scheme word may stand before it.
CONTEXT_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "pin")
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|signing|secret)[_-]?key|credentials?|auth(?:orization)?|bearer|login|pin)[\"']?[\x20\t]*+(?::=|=>|[:=])[\x20\t]*+[\"']?(?:(?:bearer|basic|digest|negotiate|token)[\x20\t]++)?([^\s\"'`<>]{6,})", re.IGNORECASE | re.ASCII)

#: Bits of guessing effort from which a value counts as a secret.
SECRET_BITS = 40.0
#: Words that people put into passwords, most frequent first.
WORDS = "password qwerty admin welcome letmein monkey dragon login master hello freedom secret summer winter spring autumn shadow sunshine princess football baseball superman batman trustno access flower love money test user root guest default changeme example demo public private key token pass".split()
#: Rows that hold a word of the corpus, at least; words of the corpus, about; words that a task counts at a time.
LEAST_ROWS, MOST_WORDS, COUNTED = 5, 50_000, 200_000
WORD = re.compile(r"[^\W\d_]{3,40}")
#: Hosts in web and mail addresses, and their bits; signs between words, and theirs.
HOST, HOST_BITS = re.compile(r"(?:https?://|@)[a-z0-9-]+(?:\.[a-z0-9-]+)+", re.IGNORECASE | re.ASCII), 10.0
SIGNS, SIGN_BITS = "-_./", 3.0
#: Longest value whose bits a task remembers.
REMEMBERED_LENGTH = 64
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKE = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEYBOARD):
        for c, x in enumerate(row):
            around = {row[k] for k in (c - 1, c + 1) if 0 <= k < len(row)}
            for other, shift in ((r - 1, (0, 1)), (r + 1, (-1, 0))):
                if 0 <= other < len(KEYBOARD):
                    around |= {KEYBOARD[other][c + s] for s in shift if 0 <= c + s < len(KEYBOARD[other])}
            near[x] = around
    return near


NEAR = neighbours()


@lru_cache(maxsize=1)
def fixed_ranks() -> dict[str, int]:
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (w[:-4] for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>"))
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())]))}


def alphabet(value: str) -> int:
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for f, n in kinds if any(f(c) for c in value))
    return size + 33 * any(not c.isalnum() for c in value) or 33


def bits_of(value: str, ranks: dict[str, int], longest: int) -> float:
    """Bits of the cheapest segmentation of value, in time linear in its length: words have a bounded length, and how far a
    block of each width comes again is found in one pass from the end."""
    n, low = len(value), value.lower()
    plain = low.translate(LOOKALIKE)
    per_char = math.log2(alphabet(value))
    best = [0.0] + [math.inf] * n

    def step(i: int, j: int, bits: float) -> None:
        if best[i] + bits < best[j]:
            best[j] = best[i] + bits

    run_start = walk_start = 0
    runs: dict[int, list[tuple[int, float]]] = {}
    for i in range(1, n + 1):  # maximal runs of one character, and maximal keyboard walks
        if i == n or low[i] != low[i - 1]:
            if i - run_start >= 3:
                runs.setdefault(run_start, []).append((i, per_char + math.log2(i - run_start) + 1))
            run_start = i
        if i == n or low[i] not in NEAR.get(low[i - 1], ()):
            if i - walk_start >= 4:
                runs.setdefault(walk_start, []).append((i, math.log2(47 * 8) + (i - walk_start)))
            walk_start = i
    again = []  # for each width, how many characters from each position on equal the one a width behind
    for width in range(2, 9):
        equal = [0] * (n + 1)
        for i in range(n - width - 1, -1, -1):
            if value[i] == value[i + width]:
                equal[i] = equal[i + 1] + 1
        again.append((width, equal))
    for i in range(n):
        step(i, i + 1, per_char)  # a brute-force span grows by characters
        for j, bits in runs.get(i, ()):
            step(i, j, bits)
        for j in range(i + 3, min(n, i + longest) + 1):
            if rank := ranks.get(plain[i:j]):
                changed = sum(a != b for a, b in zip(value[i:j], plain[i:j], strict=True))
                step(i, j, math.log2(rank) + 1 + min(changed, j - i - changed + 1))
        if value[i] in SIGNS:
            step(i, i + 1, SIGN_BITS)
        if value[i] in "hH@" and (m := HOST.match(value, i)):
            step(i, m.end(), HOST_BITS)
        if value[i].isdigit() and (m := DATE.match(value, i)):
            step(i, m.end(), math.log2(365 * 100 if m.end() - i > 4 else 100))
        for width, equal in again:  # a short block that comes again and again
            if equal[i] >= width:
                k = 1 + equal[i] // width
                step(i, i + k * width, width * per_char + math.log2(k) + 1)
    return best[n]


class Guesser:
    """Bits of values by the fixed ranks and those of a corpus."""

    def __init__(self, corpus: list[str]):
        ranks = dict(fixed_ranks())
        for k, w in enumerate(corpus):
            ranks[w] = min(k + 1, ranks.get(w, k + 1))
        longest = max(map(len, ranks))
        remembered = lru_cache(maxsize=65_536)(lambda value: bits_of(value, ranks, longest))
        self.bits = lambda value: remembered(value) if len(value) <= REMEMBERED_LENGTH else bits_of(value, ranks, longest)


@lru_cache(maxsize=1)
def fixed() -> Guesser:
    return Guesser([])


def forget() -> None:
    fixed.cache_clear()
    fixed_ranks.cache_clear()


TABLES[__name__] = forget


def guess_bits(value: str) -> float:
    return fixed().bits(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, secret_bits: float = SECRET_BITS, guesser: Guesser | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in a credential context that are dear to guess."""
    low = text.lower()
    if not (":" in text or "=" in text) or not any(c in low for c in CONTEXT_CUES):
        return []
    out, bits = [], (guesser or fixed()).bits
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)]}")
        mixed = any(c.isalpha() for c in value) and any(not c.isalpha() for c in value)
        if len(value) >= 6 and mixed and bits(value) >= secret_bits:
            out.append((m.start(1), 3, m.start(1) + len(value)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus_words(docs: DataFrame) -> list[str]:
    """Words of docs(text) by the number of rows that hold them, most frequent first; equal numbers are all taken or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            return pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        begin_task(__name__)
        counts: Counter = Counter()
        for b in batches:
            for text in texts_of(b.column(0)):
                counts.update(set(WORD.findall(CONTEXT.sub(" ", text or "").lower())))
                if len(counts) >= COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    counts = cut(docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS))
    least, total = None, 0
    for r in sorted(counts.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        if (total := total + r["count"]) > MOST_WORDS:
            break
        least = r["n"]
    return [] if least is None else [r["word"] for r in sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))]


def known_words(docs: DataFrame):
    """Function that gives the Guesser of docs' words, once in each task."""
    held = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))
    return lambda: Guesser(held.value)


def redact(text: str, mark: str = "[SECRET]", guesser: Guesser | None = None) -> str:
    """text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    for a, _, b in sorted([*base_spans(text), *guess_spans(text, guesser=guesser)]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced; every other column but n_chars, the new length, as it was."""
    small_batches(docs.sparkSession)
    names = docs.columns
    spot = names.index("text")
    schema = docs.limit(0).toArrow().schema
    words = known_words(docs)

    def run(batches):
        begin_task(__name__)
        guesser = words()
        for b in batches:
            texts = [None if t is None else redact(t, guesser=guesser) for t in texts_of(b.column(spot))]
            columns = list(b.columns)
            columns[spot] = pa.array(texts, b.schema.field(spot).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(texts, b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base, spans) of every text."""

    words = known_words(docs)

    def setup():
        guesser = words()

        def row(key, text):
            base = base_spans(text or "")
            every = sorted([*base, *guess_spans(text or "", guesser=guesser)])
            return [(key, *(sum(k == i for _, k, _ in every) for i in range(4)), joined(base), joined(every))]

        return row

    names = ["n_assign", "n_access", "n_hex", "n_guess"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base", pa.string()), ("spans", pa.string())])
    return map_rows(docs, ["doc_id", "text"], schema, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base string, spans string", setup)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
