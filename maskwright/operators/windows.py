"""Sequence operators: inference windows, token decoding, tagged sequences, constrained Viterbi paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEVER = -1e9


def token_windows(docs: DataFrame, size: int, lap: int | None = None) -> DataFrame:
    """(doc_id, win, tok, weight): tokens 0..n-1 of docs(doc_id, n) in overlapping windows; the edges of a window weigh less."""
    lap = size // 6 if lap is None else lap
    step = size - lap
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    w = docs.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    end = F.least(F.col("win") * step + size, F.col("n"))
    t = w.withColumn("len", end - F.col("win") * step).select("doc_id", "n", "win", "len", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("t"))
    weight = F.when(F.col("n") > size, 1 + F.least(F.col("t"), F.col("len") - 1 - F.col("t"), F.lit(lap))).otherwise(1)
    return t.select("doc_id", "win", (F.col("win") * step + F.col("t")).alias("tok"), weight.alias("weight"))


def averaged(windows: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """Weighted mean of a token's values over its windows."""
    return windows.groupBy(*keys).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))


def decode(tokens: DataFrame, threshold: float, floor: float, strict: bool = False) -> DataFrame:
    """Spans of tokens(doc_id, tok, start, end, category, p, gap): one row per token and class.

    A token's identifier mass decides hit, maybe or gap; neighbours of one kind and category with glue between them (gap:
    the text before the token, at most two characters of it blank or joining) are one span with their mean mass.
    """
    t = tokens if strict else tokens.where("category <> 'ORG'")
    best = t.groupBy("doc_id", "tok", "start", "end", "gap").agg(F.sum("p").alias("mass"), F.max_by("category", F.struct("p", F.negative(F.ascii("category")))).alias("category"))
    kind = F.when(F.col("mass") >= threshold, "hit").when(F.col("mass") >= floor, "maybe")
    kept = best.withColumn("kind", kind).where("kind IS NOT NULL")
    by = Window.partitionBy("doc_id").orderBy("tok")
    glued = F.coalesce((F.lag("tok").over(by) == F.col("tok") - 1) & (F.lag("kind").over(by) == F.col("kind")) & (F.lag("category").over(by) == F.col("category")) & F.col("gap").rlike(r"^[\s\-'’.,/@:_]{0,2}$"), F.lit(False))
    island = F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(by)
    return kept.withColumn("glued", glued).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("category").alias("category"), F.first("kind").alias("kind"), F.avg("mass").alias("confidence")).drop("island")


def tagged_chunks(tokens: DataFrame) -> DataFrame:
    """Chunks of tokens(doc_id, tok, tag) in BIO or BIOES: a chunk begins at B or S, after another type, or after a gap."""
    by = Window.partitionBy("doc_id").orderBy("tok")
    mark, kind = F.substring("tag", 1, 1), F.substr("tag", F.lit(3))
    t = tokens.where("tag <> 'O'").select("doc_id", "tok", mark.alias("mark"), kind.alias("kind"))
    same = F.coalesce((F.lag("tok").over(by) == F.col("tok") - 1) & (F.lag("kind").over(by) == F.col("kind")) & ~F.col("mark").isin("B", "S") & ~F.lag("mark").over(by).isin("E", "S"), F.lit(False))
    island = F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by)
    return t.withColumn("same", same).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("tok").alias("first"), (F.max("tok") + 1).alias("end"), F.first("kind").alias("kind")).drop("island")


def allowed(previous: str, tag: str) -> bool:
    """Whether tag may follow previous in BIOES ("" is before and after the sequence)."""
    inside = previous[:1] in ("B", "I")
    if inside:
        return tag[:1] in ("I", "E") and tag[2:] == previous[2:]
    return tag == "" or tag == "O" or tag[:1] in ("B", "S")


def viterbi(scores: np.ndarray, tags: list[str], biases: dict[str, float] | None = None) -> list[str]:
    """Best legal BIOES path for scores (tokens x tags); each tag's first letter may have a bias."""
    return [tags[i] for i in viterbi_places(np.asarray(scores)[None], tags, biases)[0]] if len(scores) else []


def viterbi_places(scores: np.ndarray, tags: list[str], biases: dict[str, float] | None = None) -> np.ndarray:
    """Places in tags along the best legal paths of sequences of one length: scores (sequences x tokens x tags), at least one token."""
    scores = scores + np.array([(biases or {}).get(t[:1], 0.0) for t in tags])
    move = np.array([[0.0 if allowed(a, b) else NEVER for b in tags] for a in tags])
    best, back = scores[:, 0] + np.array([0.0 if allowed("", t) else NEVER for t in tags]), []
    for k in range(1, scores.shape[1]):
        paths = best[:, :, None] + move
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[:, k]
    out = np.empty(scores.shape[:2], dtype=np.int64)
    out[:, -1] = (best + np.array([0.0 if allowed(t, "") else NEVER for t in tags])).argmax(axis=1)
    for k in range(scores.shape[1] - 2, -1, -1):
        out[:, k] = np.take_along_axis(back[k], out[:, k + 1 : k + 2], axis=1)[:, 0]
    return out


def decode_paths(tokens: DataFrame, tags: list[str], biases: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tok, tag) along the best legal path of tokens(doc_id, tok, scores array<double>).

    Scores are gathered by document; those of a batch that have as many tokens as each other go through the recursion together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(tags))
            sizes = np.diff(lists.offsets.to_numpy())
            firsts, found = np.cumsum(sizes) - sizes, np.empty(len(flat), dtype=np.int64)
            for n in np.unique(sizes):
                at = firsts[sizes == n][:, None] + np.arange(n)
                found[at] = viterbi_places(flat[at], tags, biases)
            names = pa.DictionaryArray.from_arrays(pa.array(found, pa.int32()), pa.array(tags)).cast(pa.string())
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), names)], names=["doc_id", "toks", "tags"])

    t = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok", "scores"))).alias("t"))
    t = t.select("doc_id", F.col("t.tok").alias("toks"), F.col("t.scores").alias("scores"))
    kind = tokens.schema["doc_id"].dataType.simpleString(), tokens.schema["tok"].dataType.simpleString()
    found = t.mapInArrow(run, f"doc_id {kind[0]}, toks array<{kind[1]}>, tags array<string>")
    return found.select("doc_id", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("tags").alias("tag")))).select("doc_id", F.col("tok").cast("int").alias("tok"), "tag")


def chunk_words(words: Iterator[int], limit: int, lap: int) -> list[tuple[int, int]]:
    """Windows (first, end) of words whose lengths in subwords add up to limit at most, `lap` words shared."""
    sizes, out, first = list(words), [], 0
    while first < len(sizes):
        end, total = first, 0
        while end < len(sizes) and (total + sizes[end] <= limit or end == first):
            total += sizes[end]
            end += 1
        out.append((first, end))
        if end == len(sizes):
            break
        first = max(first + 1, end - lap)
    return out


def word_windows(docs: DataFrame, limit: int, lap: int) -> DataFrame:
    """(doc_id, win, first, end) of docs(doc_id, sizes array<int>): windows of words by their lengths in subwords; a word that
    is longer than the limit by itself fails."""
    sound = F.assert_true(F.coalesce(F.array_max("sizes"), F.lit(0)) <= limit, F.lit("a word is longer than a window"))
    shape = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"first": f, "end": e} for f, e in chunk_words(iter(s or []), limit, lap)] for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=["doc_id", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.where(sound.isNull()).select("doc_id", "sizes").mapInArrow(run, f"doc_id {kind}, w array<struct<first: int, end: int>>")
    return found.select("doc_id", F.posexplode("w").alias("win", "x")).select("doc_id", "win", "x.first", "x.end")


#: A word with joined parts, or one sign.
SPLITTER = r"\w+(?:[-_]\w+)*|\S"


def text_chunks(docs: DataFrame, limit: int, lap: int | None = None) -> DataFrame:
    """(doc_id, win, start, chunk) of docs(doc_id, text): pieces of at most `limit` words or signs, a seventh of them shared."""
    step = limit - (max(1, limit // 7) if lap is None else lap)
    tokens = F.regexp_extract_all("text", F.lit(f"(?U)(?:{SPLITTER})"), F.lit(0))
    gaps = F.split("text", f"(?U)(?:{SPLITTER})")
    # Each word behind the gap before it, once a text: windows are joined from these, so a text costs what its windows hold.
    x = docs.select("doc_id", F.zip_with(gaps, tokens, lambda g, t: F.struct(g.alias("g"), t.alias("t"))).alias("__z"))
    x = x.select("doc_id", F.filter("__z", lambda z: z["t"].isNotNull()).alias("__w"))
    last = F.greatest(F.ceil((F.size("__w") - limit) / step), F.lit(0)).cast("int")
    joined = lambda words: F.array_join(F.transform(words, lambda z: F.concat(z["g"], z["t"])), "")
    w = x.select("doc_id", F.posexplode(F.transform(F.when(F.size("__w") > 0, F.sequence(F.lit(0), last)), lambda i: F.slice("__w", i * step + 1, F.lit(limit)))).alias("win", "__s"), F.col("__w"))
    first = F.get("__s", F.lit(0))["g"]
    start = F.length(joined(F.slice("__w", F.lit(1), F.col("win") * step))) + F.length(first)
    return w.select("doc_id", "win", start.alias("start"), F.substr(joined(F.col("__s")), F.length(first) + 1).alias("chunk"))


def repeated_mention(spans: DataFrame, value: Column) -> DataFrame:
    """spans with `repeat`: whether an earlier span of the document has the same value."""
    by = Window.partitionBy("doc_id", "__v").orderBy("start")
    return spans.withColumn("__v", value).withColumn("repeat", F.row_number().over(by) > 1).drop("__v")
