"""BPE encoding and decoding with a public vocabulary whose words end in a suffix.

Method: a word's part boundaries and the ranks of its adjacent pairs stand in two contiguous arrays; the lowest rank is
found by a scan, its inner boundary deleted and the neighbouring ranks refreshed, until no pair has a rank. Words above
SCAN_UP_TO parts keep the same two arrays as linked lists under a heap, which gives the same merges without a quadratic
scan. Pieces between white space are remembered per task in a table of bounded size.

Defined results: null text counts as empty; an empty text has no ids and decodes to the empty text; the vocabulary's
added tokens are found in the raw text first, as the tokenizers library does. Rows are mapped one by one: repeated rows
and extra columns change nothing, an empty table gives an empty table. Characters first assigned after Unicode 15.1 are
classed by the regex module, which knows some that the library doesn't.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import TABLES, map_rows, table

#: Longer words are merged with a heap.
SCAN_UP_TO = 64
#: Pieces remembered per task in each of two tables, the younger of which takes the place of the other when it is full, and the length above which a piece isn't.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 48

#: The characters that the normaliser's \s stands for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: What str.split() would also take for white space.
SEPARATORS = regex.compile("[\x1c-\x1f]")
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder over a tokenizers JSON file with NFC, lower case, removed white space and byte-level words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) -> rank, and the merged id of each rank
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        #: Ids of a byte inside a word and at its end
        self.inner, self.last = ([self.vocab[x + end] for x in byte_alphabet()] for end in ("", self.suffix))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.strings = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.numbers = [str(i) for i in range(len(self.strings))]

    def merged(self, parts: list[int]) -> list[int]:
        """parts of a word, merged by rank: boundaries and ranks of adjacent parts in contiguous arrays."""
        if len(parts) > SCAN_UP_TO:
            return self.merged_long(parts)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (rank := ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))
        return [p for p, ok in zip(parts, alive) if ok]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a normalised piece without white space."""
        if (ids := self.older.get(piece)) is None:
            out: list[int] = []
            inner, last = self.inner, self.last
            for word in self.words.findall(piece):
                *front, end = word.encode()
                parts = [inner[b] for b in front]
                parts.append(last[end])
                out += self.merged(parts)
            ids = tuple(out)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.older = self.known.copy()
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                ids.append(self.added[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            known = self.known
            for piece in self.white.split(part) if SEPARATORS.search(part) else part.split():
                found = known.get(piece)
                ids += self.piece(piece) if found is None else found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between them: the vocabulary names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


TABLES[__name__] = lambda: load.cache_clear()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def setup():
        b = load(path)
        return lambda key, text: [(key, b.encode(text or ""))]

    schema = pa.schema([(id_col, df.select(id_col).limit(0).toArrow().schema.field(0).type), ("ids", pa.list_(pa.int32()))])
    return map_rows(df, [id_col, text_col], schema, f"`{id_col}` {kind}, ids array<int>", setup)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text string) of every row of ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def setup():
        b = load(path)
        return lambda key, ids: [(key, b.decode(ids or []))]

    schema = pa.schema([(id_col, df.select(id_col).limit(0).toArrow().schema.field(0).type), ("text", pa.string())])
    return map_rows(df, [id_col, ids_col], schema, f"`{id_col}` {kind}, text string", setup)


def round_trip(df: DataFrame, path: str, of: Callable[[Bpe, list[int], str], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """Encode and decode in one Arrow stage; of(bpe, ids, decoded) reduces each row there, so neither crosses to the JVM."""

    def setup():
        b = load(path)

        def row(key, text):
            ids = b.encode(text or "")
            return [(key, *of(b, ids, b.decode(ids)))]

        return row

    return map_rows(df, ["doc_id", "text"], schema, ddl, setup)


def digests(b: Bpe, ids: list[int], decoded: str) -> tuple:
    numbers = b.numbers
    return len(ids), hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return round_trip(table(spark, sf_dir, "documents"), vocabulary(), digests, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
