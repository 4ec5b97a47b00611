"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the character n-grams of words (edges marked) that are typical of it: those that hold
a least share of the language's n-grams and are not far rarer there than in the language where they are most frequent.
Each language's n-grams fill a Bloom filter; the filters are bit-sliced, so one row holds a bit position of all
languages (in as many 64-bit words as they need), and the conjunction of a gram's rows is the bitmask of all languages that hold it. A text's score for a
language is the share of its n-grams in that language's filter, corrected for the filter's false positives.

Training reads a bounded sample: about SAMPLE_ROWS rows of each language, by hash of doc_id. Texts are used whole, in
training and prediction. Prediction reads nothing but the text.

Defined results: null text, or text without a letter, is "und" with score 0; a text with letters none of whose n-grams is
known has score 0 and the language with the most rows to learn from; equal scores go to the language first in order. Without
any training row, all is "und". Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin_task, map_rows, small_batches, table, texts_of

#: Training rows of each language, about: what fitting may gather.
SAMPLE_ROWS = 2_000
#: Lengths of n-grams, edge marks included.
SIZES = (2, 3, 4)
#: Least share of a language's n-grams of one length, and least ratio to the language with the greatest share.
LEAST_SHARE, LEAST_RATIO = 2e-5, 0.25
#: Bits of each filter for a gram held, and hashes.
BITS_PER_GRAM, HASHES = 16, 4
#: Languages a word of a bitmask holds.
WORD_LANGUAGES = 63

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Each code point, or the edge mark's where it is no letter."""
    return np.fromiter((p if chr(p).isalpha() else 32 for p in range(0x110000)), dtype=np.uint32, count=0x110000)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, what isn't a letter made one edge mark."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    points = alphabet()[points]
    edge = points == 32
    return points[~(edge & np.concatenate(([False], edge[:-1])))]


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit code of each n-gram of SIZES that has no edge mark inside."""
    p, out = points.astype(np.uint64), []
    edge = p == 32
    for n in SIZES:
        if len(p) < n:
            continue
        count = len(p) - n + 1
        code = np.full(count, n, dtype=np.uint64)
        inner = np.zeros(count, dtype=bool)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + p[k : k + count]
            if 0 < k < n - 1:
                inner |= edge[k : k + count]
        out.append(code[~inner])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def mixed(codes: np.ndarray) -> np.ndarray:
    x = codes ^ (codes >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bit(i: int) -> np.int64:
    """Of language i, in its word of the bitmask."""
    return np.int64(1 << i % WORD_LANGUAGES)


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  #: bitmask of languages at each bit position, an array for each word of it
    false: np.ndarray  #: false positive rate of each language
    common: str = UNKNOWN  #: the language with the most rows to learn from

    def positions(self, codes: np.ndarray, k: int) -> np.ndarray:
        return ((mixed(codes) * MULTIPLIERS[k]) >> np.uint64(64 - self.bits)).astype(np.int64)

    @property
    def bits(self) -> int:
        return self.rows.shape[1].bit_length() - 1

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """Of each code, the bitmask of all languages whose filter holds it; a word of it."""
        rows = self.rows[word]
        out = rows[self.positions(codes, 0)]
        for k in range(1, HASHES):
            out &= rows[self.positions(codes, k)]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        codes = grams(letters_of(text))
        if not len(codes):
            return self.common, 0.0
        masks, n = [self.masks(codes, w) for w in range(len(self.rows))], len(codes)
        hits = np.array([np.count_nonzero(masks[i // WORD_LANGUAGES] & bit(i)) for i in range(len(self.languages))])
        share = np.clip((hits - n * self.false) / (n * (1 - self.false)), 0, 1)
        best = int(share.argmax())
        return (self.languages[best], float(share[best])) if share[best] > 0 else (self.common, 0.0)


def typical(counts: dict[str, dict[int, int]]) -> dict[str, np.ndarray]:
    """The grams of each language that its filter holds, from its counts by gram code."""
    languages = sorted(counts)
    total = {x: max(1, sum(counts[x].values())) for x in languages}
    most: Counter = Counter()
    for x in languages:
        for g, n in counts[x].items():
            most[g] = max(most[g], n / total[x])
    return {x: np.array([g for g, n in counts[x].items() if n / total[x] >= max(LEAST_SHARE, LEAST_RATIO * most[g])], dtype=np.uint64) for x in languages}


def build(counts: dict[str, dict[int, int]], common: str = UNKNOWN) -> Filters:
    """Bit-sliced filters of each language's typical grams."""
    held = typical(counts)
    languages = sorted(held)
    size = 1 << max(10, int(BITS_PER_GRAM * max((len(h) for h in held.values()), default=1) - 1).bit_length())
    f = Filters(languages, np.zeros((max(1, -(-len(languages) // WORD_LANGUAGES)), size), dtype=np.int64), np.zeros(len(languages)), common)
    for i, x in enumerate(languages):
        word = f.rows[i // WORD_LANGUAGES]
        for k in range(HASHES):
            np.bitwise_or.at(word, f.positions(held[x], k), bit(i))
        f.false[i] = (np.count_nonzero(word & bit(i)) / size) ** HASHES
    return f


#: Values of a column up to which their counts are broadcast.
FEW_VALUES = 10_000


def sample(rows: DataFrame, by: str, per: int, key: str = "doc_id") -> DataFrame:
    """About `per` rows of each value of `by`, by hash of the key: a share of each, from one count by value."""
    sizes = sizes_of(rows, by)
    known = sizes.limit(FEW_VALUES + 1).collect()
    if len(known) <= FEW_VALUES:  # then they are sent to every task; else no value is frequent enough to skew a join on it
        sizes = F.broadcast(rows.sparkSession.createDataFrame(known, sizes.schema))
    return rows.join(sizes.select(by, (F.lit(per << 20) / F.col("rows")).alias("most")), by).where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) < F.col("most")).select(*rows.columns)


def sizes_of(rows: DataFrame, by: str) -> DataFrame:
    """(by, rows): how many rows hold each value."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from docs(doc_id, text, lang); what is brought to the driver is bounded by the sample and LEAST_SHARE."""

    def count(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                found, n = np.unique(grams(letters_of(text)), return_counts=True)
                own = counts.setdefault(lang, Counter())
                for g, k in zip(found.view(np.int64).tolist(), n.tolist(), strict=True):
                    own[g] += k
        for lang, own in counts.items():
            items = list(own.items())
            for at in range(0, len(items), 10_000):
                part = items[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "gram": [g for g, _ in part], "n": [k for _, k in part]}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = sample(labelled, "lang", sample_rows)
    sums = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = sums.join(F.broadcast(totals), "lang").where(F.col("n") >= LEAST_SHARE * F.col("total"))  # at most 1 / LEAST_SHARE grams a language
    counts: dict[str, dict[int, int]] = {}
    for r in kept.select("lang", "gram", "n").toArrow().to_pylist():
        counts.setdefault(r["lang"], {})[r["gram"] & (2**64 - 1)] = r["n"]
    common = sizes_of(labelled, "lang").orderBy(F.desc("rows"), "lang").limit(1).collect()
    return build(counts, common[0]["lang"] if common else UNKNOWN)


def part_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def predictions(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def setup():
        predict = held.value.predict
        return lambda key, text: [(key, *predict(text))]

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_rows(docs, ["doc_id", "text"], schema, "doc_id bigint, lang_pred string, score double", setup)


def rejected(filters: Filters, text: str | None, least: float) -> bool:
    """Whether a text has no language, or too small a share of known n-grams."""
    score = filters.predict(text)[1]
    return not score or score < least


def keep_identified(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """Rows of docs whose language is identified with a score of `least` or more."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(filters)
    spot = docs.columns.index("text")

    def run(batches):
        begin_task(__name__)
        for b in batches:
            yield b.filter(pa.array([not rejected(held.value, t, least) for t in texts_of(b.column(spot))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = train(docs.where(part_of(F.col("doc_id"), 4) != 2))
    return predictions(docs, filters).select("doc_id", (part_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
