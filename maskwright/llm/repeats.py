"""Repeated passages by sparse suffix arrays.

Of the suffixes of all texts (by words), only those at minimisers are kept: the positions whose GRAM-word hash is the least
in some window of the passage length. Equal passages select equal positions, so every passage of LEAST words holds a kept
suffix. Kept suffixes are sorted by their words over a range partitioning, with ties by document and position, so a
passage that a third of all documents share is dealt over many tasks; a sample of about SAMPLE_DOCS documents tells where
the ranges part, and nothing else. Neighbours (NEIGHBOURS on each side) are compared and their match extended to
the right and to the left; where both together reach LEAST words, the passage is a repeat. The farthest neighbour bounds
the match to the right with every suffix not compared. Windows of LEAST words that this bound leaves open (all windows of a
suffix near the ends of a partition) are hashed and counted over all partitions, and those that come more than once are
repeats too. The bound is the same for both suffixes of a pair, so equal windows are either compared or both counted.

A suffix carries the hashes of the words around it: 64 bits for its first GRAM words, 16 for each further one, so a repeat
may be found one word too long with a probability of 2^-16 at each end.

Defined results: words are what white space (ASCII) parts; null texts and texts of fewer than LEAST words have no repeats;
a passage that comes twice in one text is a repeat as well; identical rows are documents of their own; spans are of words,
ends exclusive. Extra columns are not looked at. Repeated doc_ids are told apart by nothing but their positions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_rows, table
from .minhash import MIX, hashes

#: Words of the shortest repeat, and of a minimiser.
LEAST, GRAM = 50, 8
#: q-grams of a window, and words to the left that may belong to a shortest repeat.
WINDOW = LEAST - GRAM + 1
LEFT = WINDOW - 1

#: low and high: the least and most words to the left of a window that has its minimiser here.
SUFFIX = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()), ("low", pa.int8()), ("high", pa.int8())])
#: Documents that the ranges are told from, about; suffixes of a range, about, at least where cores are free, and ranges at most.
SAMPLE_DOCS, RANGE, LEAST_RANGE, MOST_RANGES = 2_000, 100_000, 5_000, 5_000
SUFFIX_DDL = "part int, key bigint, right binary, left binary, doc_id bigint, at int, low tinyint, high tinyint"
FOUND = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("open", pa.int64())])
FOUND_DDL = "kind tinyint, doc_id bigint, start int, end int, key bigint, hash bigint, n bigint, open bigint"
#: Suffixes before and after it that each is compared with.
NEIGHBOURS = 8
#: Kinds of rows found: a repeat, a window that is one if it comes again, counts of a window (n in all, open of them not found yet).
REPEAT, OPEN, COUNT = 0, 1, 2
#: Of the rolling hash of a window.
BASE = np.uint64(0xD6E8FEB86659FD93)


def minimisers(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the first least value of each window of WINDOW grams, with the least and most grams before it in such a window."""
    if len(grams) < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 3
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    out = []
    for a in range(0, len(windows), 4_096):
        out.append(windows[a : a + 4_096].argmin(axis=1) + np.arange(a, min(a + 4_096, len(windows))))
    at, first, n = np.unique(np.concatenate(out), return_index=True, return_counts=True)
    return at, at - first - n + 1, at - first


def place(row: tuple) -> tuple:
    """What a suffix is sorted by."""
    key, right, left, doc_id, at = row[1:6]
    return key, right, left, -(1 << 63) if doc_id is None else doc_id, at


def suffixes(doc_id: int, text: str | None, ranges: list[tuple] = ()) -> list[tuple]:
    """Rows of SUFFIX of one text; a suffix's part is the range that holds it."""
    known = hashes()
    h = np.array([known[w] for w in (text or "").encode().split()], dtype=np.uint64)
    n = len(h)
    if n < LEAST:
        return []
    code = np.full(n - GRAM + 1, GRAM, dtype=np.uint64)
    for j in range(GRAM):
        code = (code ^ (code >> np.uint64(31))) * MIX + h[j : j + len(code)]
    code ^= code >> np.uint64(32)
    # Of each word 16 bits, none 0: that stands for no word, beyond a text's ends.
    short = np.zeros(LEFT + n + LEAST, dtype=">u2")
    short[LEFT : LEFT + n] = (h >> np.uint64(48)) | np.uint64(1)
    raw, back = short.tobytes(), short[::-1].tobytes()
    keys, out = code.view(np.int64), []
    for p, low, high in zip(*(x.tolist() for x in minimisers(code)), strict=True):
        right = raw[2 * (LEFT + p) : 2 * (LEFT + p + LEAST)]
        b = len(short) - (LEFT + p)
        out.append((0, int(keys[p]), right, back[2 * b : 2 * (b + LEFT)], doc_id, p, low, high))
    return [(bisect_right(ranges, place(row)), *row[1:]) for row in out] if ranges else out


def ranges_of(docs: DataFrame) -> list[tuple]:
    """First places of the second and later ranges, from the suffixes of a sample of documents."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = map_rows(chosen, ["doc_id", "text"], SUFFIX, SUFFIX_DDL, lambda: suffixes).toArrow()
    seen = sorted(map(place, zip(*(c.to_pylist() for c in rows.columns), strict=True)))
    every = len(seen) / share
    count = max(every / RANGE, min(docs.sparkSession.sparkContext.defaultParallelism, every / LEAST_RANGE), 1)
    count = int(min(count, MOST_RANGES, len(seen) // 8 + 1))
    return [seen[k * len(seen) // count] for k in range(1, count)]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows of a and b share from their start; 0 stands for no word and is shared with none."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u2").reshape(-1, width)


def window_hashes(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each suffix, the hashes of the LEAST words that begin 0 to LEFT words to the left of it."""
    codes = np.concatenate([left[:, ::-1], right], axis=1).astype(np.uint64) * MIX
    codes ^= codes >> np.uint64(29)
    sums = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        sums[:, k + 1] = sums[:, k] * BASE + codes[:, k]
    power = np.uint64(pow(int(BASE), LEAST, 1 << 64))
    out = sums[:, LEAST:] - sums[:, :-LEAST] * power  # by the window's first word, from the left
    return (out ^ (out >> np.uint64(32)))[:, ::-1]


def found_rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function over sorted suffixes: repeats among neighbours, windows that may come again farther away, and counts of those windows."""
    held, done, begins = None, 0, True  # suffixes carried over, how many of them are finished, whether they are the partition's first
    for b in chain(batches, [None]):
        if b is not None:
            b = pa.RecordBatch.from_arrays(b.columns, schema=SUFFIX)
            whole = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
        elif held is None:
            return
        else:
            whole = held
        n = whole.num_rows
        ready = n if b is None else n - NEIGHBOURS
        if ready <= done:
            held = whole if n else None
            continue
        key, doc_id, at = (whole.column(k).to_numpy() for k in (1, 4, 5))
        at = at.astype(np.int64)
        right, left = matrix(whole.column(2), LEAST), matrix(whole.column(3), LEFT)
        # The most words to the left and right shared with a neighbour, and to the right with a suffix not compared.
        l_most, r_most, beyond = (np.zeros(n, dtype=np.int64) for _ in range(3))
        for d in range(1, min(NEIGHBOURS, n - 1) + 1):
            i = np.flatnonzero(key[:-d] == key[d:])
            r, x = common(right[i], right[i + d]), common(left[i], left[i + d])
            if d == NEIGHBOURS:
                for j in (i, i + d):
                    beyond[j] = np.maximum(beyond[j], r)
            good = r + x >= LEAST
            i, r, x = i[good], r[good], x[good]
            for j in (i, i + d):  # no position comes twice in either
                l_most[j], r_most[j] = np.maximum(l_most[j], x), np.maximum(r_most[j], r)
        # Runs may go on in the next partition, or have begun in the one before.
        if b is None:
            beyond[-NEIGHBOURS:][key[-NEIGHBOURS:] == key[-1]] = LEAST
        if begins:
            beyond[:NEIGHBOURS][key[:NEIGHBOURS] == key[0]] = LEAST
        own = np.arange(n)
        own = (own >= done) & (own < ready)
        k = np.flatnonzero(own & (r_most > 0))
        yield found_rows(REPEAT, doc_id=doc_id[k], start=at[k] - l_most[k], end=at[k] + r_most[k])
        low, high = (whole.column(c).to_numpy().astype(np.int64) for c in (6, 7))
        low = np.maximum(low, LEAST - beyond)
        todo = np.flatnonzero(own & (low <= high))
        for c in range(0, len(todo), 4_096):
            k = todo[c : c + 4_096]
            offset = np.arange(LEFT + 1)
            i, o = np.nonzero((offset >= low[k, None]) & (offset <= high[k, None]))
            codes = window_hashes(right[k], left[k])[i, o].view(np.int64)
            i = k[i]
            open_ = (o > l_most[i]) | (LEAST - o > r_most[i])
            start = at[i] - o
            yield found_rows(OPEN, doc_id=doc_id[i][open_], start=start[open_], end=start[open_] + LEAST, key=key[i][open_], hash=codes[open_])
            by = np.lexsort((codes, key[i]))
            keys, codes, open_ = key[i][by], codes[by], open_[by].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1]))))
            yield found_rows(COUNT, key=keys[first], hash=codes[first], n=np.diff(np.append(first, len(keys))), open=np.add.reduceat(open_, first))
        cut_at = max(0, ready - NEIGHBOURS)
        held, done, begins = whole.slice(cut_at), ready - cut_at, begins and not cut_at


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (doc_id, start, end) of each document as one."""
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word) of every passage of LEAST or more words that comes more than once."""
    docs = docs.select("doc_id", "text")
    ranges = ranges_of(docs)
    rows = map_rows(docs, ["doc_id", "text"], SUFFIX, SUFFIX_DDL, lambda: partial(suffixes, ranges=ranges))
    order = ["key", "right", "left", "doc_id", "at"]
    found = cut(rows.repartitionById(len(ranges) + 1, F.col("part")).sortWithinPartitions(*order).select(*SUFFIX.names).mapInArrow(compare, FOUND_DDL))
    again = found.where(F.col("kind") == COUNT).groupBy("key", "hash").agg(F.sum("n").alias("n"), F.sum("open").alias("open")).where("n > 1 AND open > 0").select("key", "hash")
    farther = found.where(F.col("kind") == OPEN).select("doc_id", "start", "end", "key", "hash").join(again, ["key", "hash"])
    return merged(found.where(F.col("kind") == REPEAT).select("doc_id", "start", "end").union(farther.select("doc_id", "start", "end")))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
