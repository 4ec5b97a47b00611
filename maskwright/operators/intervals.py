"""Interval algebra over half-open spans: union of overlaps, subtraction, coverage, overlap semi- and anti-joins.

Long form: one row per span with a document key. All joins are equi-joins on the key with the overlap as a further
condition, sorted on the key by hint, as sizes of spans that are made from other columns are estimated far too low and would be
sent through the driver; AQE may split a hot key. `fold_*` are the same operators on Python
lists, for use inside an Arrow stage that already holds a document.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.categories import BONUS


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open spans share a position; touching ones don't."""
    return (a_start < b_end) & (b_start < a_end)


def rank(source: Column, confidence: Column) -> Column:
    bonus = F.lit(0.0)
    for k, v in BONUS.items():
        bonus = F.when(source == k, F.lit(v)).otherwise(bonus)
    return bonus + confidence


def merge(spans: DataFrame, key: str = "doc_id", start: str = "start", end: str = "end", seq: str = "seq", score: Column | str = "score", carry: list[str] | None = None) -> DataFrame:
    """Union of overlapping spans: least start, greatest end, carried columns of the best score (the first in order wins ties).

    One shuffle by key: the window that finds islands and the sums over them share it.
    """
    score = F.col(score) if isinstance(score, str) else score
    by = Window.partitionBy(key).orderBy(F.col(start), F.col(end).desc(), F.col(seq))
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    with_order = spans.withColumn("__reach", reach).withColumn("__ord", F.row_number().over(by)).withColumn("__score", score)
    fresh = F.when(F.col("__reach").isNull() | (F.col(start) >= F.col("__reach")), 1).otherwise(0)
    islands = with_order.withColumn("__island", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct(F.col("__score"), -F.col("__ord"))
    carried = [F.max_by(c, best).alias(c) for c in carry or []]
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), *carried).drop("__island")


def subtract(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of a that overlap no span of b (whole spans; nothing is clipped)."""
    x, y = a.alias("a"), b.alias("b").hint("merge")
    return x.join(y, (F.col(f"a.{key}") == F.col(f"b.{key}")) & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")), "left_anti")


def touching(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of a that overlap any span of b."""
    x, y = a.alias("a"), b.alias("b").hint("merge")
    return x.join(y, (F.col(f"a.{key}") == F.col(f"b.{key}")) & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")), "left_semi")


def contained(a: DataFrame, b: DataFrame, key: str = "doc_id", keep: bool = False) -> DataFrame:
    """Spans of a that lie inside none (or, with keep, any) of b."""
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    return a.alias("a").join(b.alias("b").hint("merge"), inside, "left_semi" if keep else "left_anti")


def coverage(gold: DataFrame, predicted: DataFrame, key: str = "doc_id", gold_id: str = "gold_id") -> DataFrame:
    """gold with `covered`: positions of each span that disjoint predictions cover."""
    p = predicted.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    hit = (F.col(key) == F.col("__k")) & overlap(F.col("start"), F.col("end"), F.col("__s"), F.col("__e"))
    sums = gold.select(key, gold_id, "start", "end").join(p.hint("merge"), hit).groupBy(key, gold_id).agg(F.sum(F.least("end", "__e") - F.greatest("start", "__s")).alias("covered"))
    return gold.join(sums.hint("merge"), [key, gold_id], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def free_places(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Places of the spans that overlap none kept before them."""

    def one(s: list[int], e: list[int]) -> list[int]:
        kept, kept_starts, kept_ends = [], [], []
        for i, (a, b) in enumerate(zip(s, e, strict=True)):
            k = bisect_right(kept_ends, a)
            if k == len(kept_ends) or kept_starts[k] >= b:
                kept.append(i)
                kept_starts.insert(k, a)
                kept_ends.insert(k, b)
        return kept

    return pd.Series([one(list(s), list(e)) for s, e in zip(starts, ends, strict=True)], dtype=object)


def greedy(spans: DataFrame, order: list[tuple[str, bool]], key: str = "doc_id") -> DataFrame:
    """Spans kept one after another in order (column, descending) while they overlap none kept before.

    A sequential choice within a document: its sorted ends go through Arrow, and places of what is kept come back; each is
    found by halving among the kept ones, so a document of many spans costs little more than sorting it.
    """
    fields = [F.when(F.lit(desc), -F.col(c)).otherwise(F.col(c)).cast("double").alias(f"o{i}") for i, (c, desc) in enumerate(order)]
    span = F.struct(*fields, *[F.col(c) for c in spans.columns if c != key])
    rows = spans.groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("__all"))
    ends = lambda name: F.transform("__all", lambda s: s[name].cast("bigint"))
    rows = rows.withColumn("__kept", free_places(ends("start"), ends("end")))
    return rows.select(key, F.explode(F.transform("__kept", lambda i: F.get("__all", i))).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in spans.columns if c != key])


def resolve_by_score(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    return greedy(spans, [("score", True), ("start", False), ("seq", False)], key)


def resolve_longest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    return greedy(spans.withColumn("__size", F.col("end") - F.col("start")), [("__size", True), ("start", False), ("seq", False)], key).drop("__size")


# --- on one document's Python lists: (start, end, category, source, confidence, dob) ---------------------------------


def fold_merge(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        mine = BONUS[s[3]] + s[4]
        if out and s[0] < out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], s[1])
            if mine > last[6]:
                last[2:] = [*s[2:6], mine]
        else:
            out.append([*s[:6], mine])
    return [tuple(s[:6]) for s in out]


def fold_subtract(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Spans of a that overlap none of b, which are disjoint and sorted."""
    ends = [y[1] for y in b]
    return [x for x in a if (k := bisect_right(ends, x[0])) == len(b) or b[k][0] >= x[1]]


def reviewed(spans: DataFrame, manual: DataFrame, off: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans after a review: those switched off (key, start, end) are left out, marked ones (key, start, end, category) come
    in with the highest standing and take in whatever they overlap."""
    kept = spans.join(off.select(key, "start", "end").hint("merge"), [key, "start", "end"], "left_anti").select(key, "start", "end", "category", "source", "confidence")
    marked = manual.select(key, "start", "end", "category", F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"))
    both = kept.unionByName(marked).withColumn("seq", F.xxhash64("category", "source"))
    return merge(both, key, score=rank(F.col("source"), F.col("confidence")), carry=["category", "source", "confidence"])
