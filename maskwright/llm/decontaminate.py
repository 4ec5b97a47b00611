"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, everything but letters and digits one space). An item that stands in a document with
at most k errors leaves one of any k+1 pieces of it unharmed: each item is cut into k+1 pieces, an automaton over all
pieces finds their exact hits, and each hit's window is verified with Myers' bit-parallel distance. Windows that share too
few 3-grams with the item to be within k errors are passed over before that.

Items are scanned for in blocks of bounded size (BLOCK_CHARS), one pass over the documents each, so what is sent to the
executors has a bound however large the benchmark is.

Defined results: null or wordless items match nothing, nor do null and wordless documents; items of fewer than SHORT
normalised characters match only without errors, at word edges; repeated items and rows give their rows as often as
distinct (doc row, item_id, text) pairs; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Errors for each character of an item, and characters below which an item must match exactly.
ERROR_SHARE, SHORT = 0.08, 20
#: Characters of items scanned for in one pass.
BLOCK_CHARS = 4_000_000

OTHER = re.compile(r"[\W_]+")
GRAM = 3


def normal(text: str | None) -> str:
    """Words of text with one space around each."""
    words = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def errors_of(size: int) -> int:
    return int(size * ERROR_SHARE) if size >= SHORT else 0


def pieces(pattern: str, k: int) -> Iterator[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of pattern, in lengths that differ by one at most."""
    edges = [len(pattern) * i // (k + 1) for i in range(k + 2)]
    for a, b in zip(edges, edges[1:]):
        yield a, pattern[a:b]


def distance(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """(least edit distance of pattern to a substring of text, end of the first such substring), bit-parallel."""
    m = len(pattern)
    whole, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = whole, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (whole & ~(across | plus))
        down = plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & whole, (down << 1) & whole
        plus, minus = down | (whole & ~(vertical | up)), up & vertical
        if score < best:
            best, at = score, j
    return best, at


@dataclass
class Item:
    item_id: int
    pattern: str
    k: int
    masks: dict[str, int]
    grams: dict[str, int]


class Scanner:
    """Automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, owners = [], defaultdict(list)
        for item_id, text in items:
            if not (pattern := normal(text)):
                continue
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(pattern):
                masks[c] |= 1 << i
            grams: dict[str, int] = defaultdict(int)
            for i in range(len(pattern) - GRAM + 1):
                grams[pattern[i : i + GRAM]] += 1
            k = errors_of(len(pattern))
            for offset, piece in pieces(pattern, k):
                owners[piece].append((len(self.items), offset))
            self.items.append(Item(item_id, pattern, k, dict(masks), dict(grams)))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def near(self, item: Item, window: str) -> bool:
        """Whether window shares as many 3-grams with the item as k errors leave at least."""
        need = len(item.pattern) - GRAM + 1 - item.k * GRAM
        if need <= 0:
            return True
        left = dict(item.grams)
        for i in range(len(window) - GRAM + 1):
            if left.get(g := window[i : i + GRAM], 0):
                left[g] -= 1
                need -= 1
                if need <= 0:
                    return True
        return False

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, errors allowed, end in the normalised text) of every item in text."""
        t = normal(text)
        if not t or not self.any:
            return []
        windows = defaultdict(set)
        for end, (size, of) in self.automaton.iter(t):
            for i, offset in of:
                windows[i].add(end + 1 - size - offset)
        out = []
        for i, starts in sorted(windows.items()):
            item = self.items[i]
            m, k, best, done = len(item.pattern), item.k, None, -1
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(t), s + m + k)
                if b <= done:  # the window before held this one
                    continue
                window = t[a:b]
                if k == 0:
                    found = (0, b - a) if window == item.pattern else None
                elif self.near(item, window):
                    found = distance(item.pattern, item.masks, window)
                    done = b
                else:
                    continue
                if found and found[0] <= k and (best is None or found[0] < best[0]):
                    best = (found[0], a + found[1])
            if best:
                out.append((item.item_id, best[0], k, best[1]))
        return out


def item_blocks(bench: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of about block_chars."""
    items = bench.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, errors, end) of every item found in a document."""
    out = None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("errors", pa.int32()), ("end", pa.int64())])
    for items in item_blocks(bench):

        def setup(items=items):
            scanner = Scanner(items)
            return lambda key, text: [(key, *m) for m in scanner.matches(text)]

        found = map_rows(docs, ["doc_id", "text"], schema, "doc_id bigint, item_id bigint, distance int, errors int, end bigint", setup)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows in which an item is found."""
    spot = docs.columns.index("text")
    for items in item_blocks(bench):

        def run(batches, items=items):
            scanner = Scanner(items)
            for b in batches:
                yield b.filter(pa.array([not scanner.matches(t) for t in b.column(spot).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
