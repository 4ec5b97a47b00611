"""Near-duplicate groups by b-bit MinHash.

A text's set of word shingles has BANDS x ROWS minima. Band keys come from whole minima; of SIGNED of them the low two
bits are kept, packed into 64-bit words, and the similarity of a candidate pair is estimated from the count of equal
lanes, corrected for lanes that agree by chance. Pairs whose estimate could belong to a link are confirmed on their full
sets.

Groups of any size stay cheap without all their pairs as rows: equal sets are one class; in rounds, each bucket's members
are compared with one or two hubs of it, and links join members into components. What is left are members outside the
largest component of one of their buckets. They and the members that they share such buckets with are dealt in blocks of
bounded size, each pair of blocks is one step of a task, and pairs are formed, estimated and confirmed inside it; only
links leave it. So no link that a bucket holds is left out. With these bands, a pair at the least similarity shares no
bucket with probability (1 - 0.8^6)^32 < 0.0001.

Defined results: null, empty and white-space texts have no shingles, link with nothing and are their own component; a text
with fewer words than a shingle is one shingle; identical rows count as copies, rows of one doc_id with different texts as
documents of their own; a null doc_id takes no part in linking, its component is null unless its set comes with an id too.
Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TABLES, begin_task, cut, fresh_path, map_rows, release, remove, table
from .graph import components

BANDS, ROWS = 32, 6
#: Minima whose low bits are kept, and bits of each.
SIGNED, LOW_BITS = 128, 2
#: Standard errors by which an estimate may fall short of the least similarity.
SLACK = 5.0
#: Comparisons left for each member row below which rounds of hubs end.
UNSETTLED = 32
#: Shingles of a block on the side of the open members and on the other: at first, and once there are MANY blocks.
OPEN_BLOCK, BLOCK, MANY = (1 << 14, 1 << 20), (1 << 16, 1 << 22), 16
#: Shingles that a set counts for at least in a block, and pairs that are estimated at a time.
LEAST_SIZE, PAIRS = 32, 1 << 20
#: Columns of the matrices whose product counts common shingles, and pairs up to which they are counted singly.
COLUMNS, SINGLY = 4_096, 64
#: Words whose hashes a task remembers.
REMEMBERED = 100_000

_rng = np.random.default_rng(20_240_501)
FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


TABLES[__name__] = lambda: hashes.cache_clear()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the k-word shingles of text; of all its words, if fewer."""
    known = hashes()
    h = np.array([known[w] for w in (text or "").encode().lower().split()], dtype=np.uint64)  # bytes: only A-Z, and ASCII white space
    if not len(h):
        return h
    width = min(k, len(h))
    code = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        code = (code ^ (code >> np.uint64(31))) * MIX + h[j : j + len(code)]
    return np.unique(code ^ (code >> np.uint64(32)))


def minima(codes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), 1_024):
        np.minimum(out, (codes[None, at : at + 1_024] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    code = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        code = (code ^ (code >> np.uint64(29))) * MIX + column
    return (code ^ (code >> np.uint64(32))).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """Low two bits of the first SIGNED minima, in 64-bit words."""
    per = 64 // LOW_BITS
    low = ((least[:SIGNED] ^ (least[:SIGNED] >> np.uint64(32))) & np.uint64(3)).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def least_equal(similarity: float) -> int:
    """Equal lanes that a pair of at least this similarity has, but for SLACK standard errors."""
    chance = 2.0**-LOW_BITS
    p = chance + (1 - chance) * similarity
    return int(SIGNED * p - SLACK * (SIGNED * p * (1 - p)) ** 0.5)


def estimate(equal: float) -> float:
    """Similarity from the share of equal lanes, corrected for those that agree by chance."""
    chance = 2.0**-LOW_BITS
    return (equal - chance) / (1 - chance)


def alike(a: str, b: str, similarity: float) -> Column:
    """Whether structs a and b (n, sig) may be linked, by sizes and signatures."""
    odd = lambda i: F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
    lanes = lambda x: F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    unequal = sum((lanes(odd(i)) for i in range(1, SIGNED * LOW_BITS // 64)), lanes(odd(0)))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * round(similarity * 100)) & (F.lit(SIGNED) - unequal >= least_equal(similarity))


def in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Of each set of x with each of y, how many shingles both hold."""
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    words, code_x = np.unique(np.concatenate(x), return_inverse=True)
    row_x = np.repeat(np.arange(len(x)), [len(s) for s in x])
    all_y, row_y = np.concatenate(y), np.repeat(np.arange(len(y)), [len(s) for s in y])
    code_y = np.minimum(np.searchsorted(words, all_y), len(words) - 1)
    held = words[code_y] == all_y
    code_y, row_y = code_y[held], row_y[held]
    by_x, by_y = np.argsort(code_x, kind="stable"), np.argsort(code_y, kind="stable")
    code_x, row_x, code_y, row_y = code_x[by_x], row_x[by_x], code_y[by_y], row_y[by_y]
    for at in range(0, len(words), COLUMNS):
        i, j = (slice(*np.searchsorted(c, (at, at + COLUMNS))) for c in (code_x, code_y))
        one, two = np.zeros((len(x), COLUMNS), dtype=np.float32), np.zeros((len(y), COLUMNS), dtype=np.float32)
        one[row_x[i], code_x[i] - at] = 1
        two[row_y[j], code_y[j] - at] = 1
        out += one @ two.T
    return out


def linked_pairs(x: list[np.ndarray], y: list[np.ndarray], wanted: np.ndarray, percent: int) -> np.ndarray:
    """Of the wanted pairs (a row for each set of x, a column for each of y), those whose full sets reach the similarity."""
    size_x, size_y = (np.array([len(s) for s in side]) for side in (x, y))
    wanted = wanted & (100 * np.minimum(size_x[:, None], size_y) >= percent * np.maximum(size_x[:, None], size_y))
    i, j = np.nonzero(wanted)
    if len(i) <= SINGLY:
        both = np.array([len(np.intersect1d(x[a], y[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        rows, columns = np.unique(i), np.unique(j)
        both = in_common([x[a] for a in rows], [y[b] for b in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    out = np.zeros_like(wanted)
    if len(i):
        good = 100 * both >= percent * (size_x[i] + size_y[j] - both)
        out[i[good], j[good]] = True
    return out


def may_link(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Of rows of signatures x with those of y, whether their equal lanes allow the similarity."""
    unequal = np.zeros((len(x), len(y)), dtype=np.int64)
    for w in range(x.shape[1]):
        odd = x[:, None, w] ^ y[None, :, w]
        unequal += np.bitwise_count((odd | (odd >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return SIGNED - unequal >= least_equal(similarity)


Member = tuple[int, bool, bool, list[int], str]


def links_of(group: list[Member], k: int, similarity: float) -> list[tuple[int, int]]:
    """Links enough to connect the open members of a pair of blocks with whatever they link to in it. Of the others of one
    component (main), one link of each open member does."""
    x, y = [m for m in group if m[1]], [m for m in group if not m[1]]
    if not x or not y:
        return []
    ids_x, ids_y = np.array([m[0] for m in x]), np.array([m[0] for m in y])
    main = np.array([m[2] for m in y])
    sig_x, sig_y = (np.array([m[3] for m in side], dtype=np.int64).view(np.uint64) for side in (x, y))
    out, step = [], max(1, PAIRS // len(y))
    set_of = lru_cache(maxsize=None)(lambda j: shingles(y[j][4], k))
    for at in range(0, len(x), step):
        ids = ids_x[at : at + step]
        wanted = may_link(sig_x[at : at + step], sig_y, similarity) & (ids[:, None] != ids_y) & (main | (ids[:, None] > ids_y))
        rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        if not len(rows):
            continue
        sets_x, sets_y = [shingles(x[at + i][4], k) for i in rows], [set_of(j) for j in columns.tolist()]
        linked = linked_pairs(sets_x, sets_y, wanted[np.ix_(rows, columns)], round(similarity * 100))
        for i, row in zip(rows.tolist(), linked, strict=True):
            found = columns[row]
            in_main = found[main[found]][:1]
            out.extend((int(ids[i]), int(ids_y[j])) for j in [*in_main, *found[~main[found]]])
    return out


def blocks(total: Column, sizes: tuple[int, int]) -> Column:
    """Blocks that hold about sizes[0] shingles each; where that makes more than MANY, about sizes[1]."""
    return F.greatest(F.lit(1), F.least(F.ceil(total / sizes[0]), MANY + F.ceil(total / sizes[1]))).cast("int")


def compared(x: DataFrame, y: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) of the members x(g, id, n) of each group g with the members y(g, id, n, main) of the same group."""
    size = F.sum(F.greatest("n", F.lit(LEAST_SIZE)))
    counts = x.groupBy("g").agg(blocks(size, OPEN_BLOCK).alias("xs")).join(y.groupBy("g").agg(blocks(size, BLOCK).alias("ys")), "g")
    one = lambda count: F.pmod(F.xxhash64("id", F.lit(3)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    open_ = x.join(counts, "g").select("g", one("xs").alias("xb"), every("ys").alias("yb"), F.lit(True).alias("open"), F.lit(False).alias("main"), "id")
    other = y.join(counts, "g").select("g", every("xs").alias("xb"), one("ys").alias("yb"), F.lit(False).alias("open"), "main", "id")
    rows = open_.union(other).join(texts, "id").select("g", "xb", "yb", "id", "open", "main", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        now, group = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if found := links_of(group, k, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

        for b in batches:
            for g, xb, yb, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, xb, yb) != now:
                    yield from done()
                    now, group = (g, xb, yb), []
                group.append(tuple(member))
        yield from done()

    return rows.repartition("g", "xb", "yb").sortWithinPartitions("g", "xb", "yb").mapInArrow(run, "a bigint, b bigint")


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, spot, n, node, bands, sig) of every document; spot is a hash of the text, node one of the set."""

    def setup():
        def row(key, spot, text):
            codes = shingles(text, k)
            if not len(codes):
                return [(key, spot, 0, None, [], [])]
            least, node = minima(codes), xxhash.xxh3_64_intdigest(codes.tobytes())
            return [(key, spot, len(codes), node - (node >> 63 << 64), band_keys(least).tolist(), packed(least).tolist())]

        return row

    schema = pa.schema([("doc_id", pa.int64()), ("spot", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
    with_spot = docs.select("doc_id", F.xxhash64("text").alias("spot"), "text")
    return map_rows(with_spot, ["doc_id", "spot", "text"], schema, "doc_id bigint, spot bigint, n bigint, node bigint, bands array<bigint>, sig array<bigint>", setup)


def near_duplicates(docs: DataFrame, k: int, similarity: float = 0.8) -> DataFrame:
    """(doc_id, spot, n_shingles, component_id) of every row of docs(doc_id, text); spot is xxhash64(text)."""
    spark = docs.sparkSession
    rows = cut(signatures(docs, k))
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("doc_id", "spot")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    spread = classes.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    # Signatures are attached to what is left: most bands of most texts are theirs alone.
    members = cut(spread.join(shared, "bucket").join(classes.select("id", "n", "sig"), "id").select("bucket", F.struct("id", "n", "sig").alias("m")))
    path = fresh_path(spark, "texts")
    wanted = members.select("m.id").distinct().join(classes.select("id", "one.doc_id", "one.spot", "sig"), "id")
    docs.select("doc_id", F.xxhash64("text").alias("spot"), "text").join(wanted, ["doc_id", "spot"]).dropDuplicates(["doc_id", "spot"]).select("id", "sig", "text").write.parquet(path)
    texts = spark.read.parquet(path)
    release(spark)
    named = components(settle(members, lambda x, y: compared(x, y, texts, k, similarity), similarity))
    remove(spark, path)  # links and components are written by now
    least = named.join(classes.select("id", "one.doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = classes.select(F.col("id").alias("node"), F.col("one.doc_id").alias("first_id"))
    joined = named.join(least, "component").select(F.col("id").alias("node"), "component_id")
    whole = rows.select("doc_id", "spot", "n", "node").join(alone.join(joined, "node", "left"), "node", "left")
    return whole.select("doc_id", "spot", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first_id", "doc_id").alias("component_id"))


def settle(members: DataFrame, compare: Callable[[DataFrame, DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links enough to connect whatever the buckets of members(bucket, m struct<id, n, sig>) link."""
    links, turn, before = members.sparkSession.createDataFrame([], "a long, b long"), 0, 0
    now = members.withColumn("c", F.col("m.id"))
    while True:
        parts = now.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), F.max_by("c", F.struct("k", "c")).alias("major"), F.max("k").alias("most")).where("parts > 1")
        open_ = cut(parts.select("bucket", "n", "major", ((F.col("n") - F.col("most")) * F.col("n")).alias("work")))
        work, rows = open_.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        if not rows:
            return links
        now = now.join(open_.select("bucket", "major"), "bucket")
        if turn and (work <= UNSETTLED * rows or 2 * work > before):
            return links.union(cut(compare(*left_over(now, open_))))
        any_, outside = (F.when(ok, F.struct("m", "c")) for ok in (F.lit(True), F.col("c") != F.col("major")))
        by = F.xxhash64("m.id", F.lit(turn))
        hubs = now.groupBy("bucket").agg(F.array_distinct(F.array_compact(F.array(F.min_by(any_, by), *[F.min_by(outside, F.when(outside.isNotNull(), by))] * bool(turn)))).alias("hubs"))
        hubs = hubs.select("bucket", F.explode("hubs").alias("h")).select("bucket", F.col("h.m").alias("y"), F.col("h.c").alias("d"))
        found = now.select("bucket", "c", F.col("m").alias("x")).join(hubs, "bucket").where((F.col("c") != F.col("d")) & alike("x", "y", similarity))
        pairs = cut(found.select(F.col("y.id").alias("g"), F.col("y.n").alias("hub_n"), F.col("x.id").alias("id"), F.col("x.n").alias("n")).distinct())
        hub = pairs.select("g", F.col("g").alias("id"), F.col("hub_n").alias("n"), F.lit(True).alias("main")).distinct()
        links = links.union(cut(compare(pairs.select("g", "id", "n"), hub)))
        turn, before = turn + 1, work
        named = components(links)
        links = named.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))  # as good as all links so far
        now = cut(now.drop("major").withColumn("id", F.col("m.id")).join(named, "id", "left").select("bucket", "m", F.coalesce("component", "c").alias("c")))
        release(members.sparkSession)


def left_over(now: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members x(g, id, n) outside the largest component of one of their buckets, and y(g, id, n, main) to compare them with.

    Buckets with the same largest component form a group, so that members that meet in many buckets are compared once; only
    where that would make many more pairs than the buckets hold, each bucket stays a group of its own.
    """
    member = F.struct(F.col("m.n").alias("n"), F.col("c"))
    tied = cut(now.groupBy(F.col("major").alias("g"), F.col("m.id").alias("id")).agg(F.min(member).alias("v")).select("g", "id", "v.n", (F.col("v.c") == F.col("g")).alias("main")))
    pairs = tied.groupBy("g").agg((F.count("*") * F.count_if(~F.col("main"))).alias("pairs"))
    held = open_.groupBy(F.col("major").alias("g")).agg(F.sum("work").alias("work"))
    wide = pairs.join(held, "g").where(F.col("pairs") > 4 * F.col("work")).select("g")
    single = now.join(wide.withColumnRenamed("g", "major"), "major", "left_semi").select(F.col("bucket").alias("g"), "m.id", "m.n", (F.col("c") == F.col("major")).alias("main"))
    rows = cut(tied.join(wide, "g", "left_anti").union(single))
    return rows.where(~F.col("main")).select("g", "id", "n"), rows


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), 2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
