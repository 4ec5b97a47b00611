"""Leak-oriented evaluation of spans against gold spans.

gold(doc_id, gold_id, start, end, label, tags) counts every parsed span, policy-kept ones too; predicted spans are disjoint.
Lengths are UTF-8 bytes, as the measures weigh characters of identifiers in bytes; clean characters are code points.
All joins are equi-joins on doc_id; a document's spans meet its text once, as arrays, and only their measures go on. Sizes of
made-up texts and arrays are estimated far too low, so these joins are sorted ones by hint: none is sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.register import with_mapped_labels
from .intervals import overlap, touching


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def in_policy(gold: DataFrame, strict: bool = False) -> DataFrame:
    """Gold spans whose label counts as an identifier, with their category."""
    mapped = with_mapped_labels(gold)
    mapped = mapped.where(F.col("category") != "KEEP") if strict else mapped.where(~F.col("category").isin("KEEP", "QUASI"))
    return mapped.withColumn("category", F.when(F.col("category") == "QUASI", "ORG").otherwise(F.col("category")))


def measured(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """gold with byte length `size`, non-blank bytes `body` and bytes inside predictions `covered`; ages below 90 left out.

    A document's gold spans and its predictions meet its text as two arrays, and are measured there.
    """
    names = [c for c in gold.columns if c != "doc_id"]
    spans = gold.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("g"))
    made = predicted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("made"))
    x = docs.select("doc_id", "text").join(spans.hint("merge"), "doc_id").join(made.hint("merge"), "doc_id", "left")
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def measure(g: Column) -> Column:
        part = g["__part"]
        hits = F.filter(F.coalesce("made", none), lambda p: overlap(g["start"], g["end"], p["start"], p["end"]))
        covered = F.aggregate(hits, F.lit(0), lambda n, p: n + F.octet_length(between(F.col("text"), F.greatest(g["start"], p["start"]), F.least(g["end"], p["end"]))))
        old = F.when(g["category"] == "AGE", F.coalesce(F.regexp_replace(part, "[^0-9]", "").try_cast("long") >= 90, F.lit(False)))
        return F.struct(*[g[n].alias(n) for n in names], F.octet_length(part).alias("size"), F.octet_length(F.regexp_replace(part, r"(?U)\s", "")).alias("body"), covered.alias("covered"), old.alias("old"))

    # An inner inline is optimised to test the size of what is measured first, for which all would be measured twice; g is never empty.
    parts = F.transform("g", lambda g: g.withField("__part", between(F.col("text"), g["start"], g["end"])))
    out = x.select("doc_id", F.inline_outer(F.transform(parts, measure)))
    return out.where("category <> 'AGE' OR old").drop("old")


def outcomes(gold: DataFrame, predicted: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """Each in-policy gold span with covered, caught, full, covered_chars and outcome (2 whole, 1 partly, 0 missed)."""
    return judged(measured(in_policy(gold, strict), predicted, docs))


def judged(g: DataFrame) -> DataFrame:
    """Measured spans with caught, full, covered_chars, outcome and item."""
    blank, cov = F.col("size") - F.col("body"), F.col("covered")
    covered = F.greatest(F.least(cov - F.least(blank, cov), F.col("body")), F.when(cov >= F.col("size"), F.col("body")).otherwise(0))
    g = g.withColumn("caught", cov > 0).withColumn("full", (cov + blank >= F.col("size")) & (cov > 0)).withColumn("covered_chars", covered)
    return g.withColumn("outcome", F.when(F.col("full"), 2).when(F.col("caught"), 1).otherwise(0)).withColumn("item", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("gold_id").cast("string")))


SUMS = ("gold", "caught", "full", "gold_chars", "covered_chars")


def sums() -> list[Column]:
    return [F.count("*").alias("gold"), F.count_if("caught").alias("caught"), F.count_if("full").alias("full"), F.sum("body").alias("gold_chars"), F.sum("covered_chars").alias("covered_chars")]


def by_category(scored: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts by gold category, with predictions counted by their own; a prediction is right if it touches any gold span."""
    right = touching(predicted.withColumn("p", F.monotonically_increasing_id()) if "seq" not in predicted.columns else predicted, gold)
    made = predicted.groupBy("category").agg(F.count("*").alias("predicted"))
    good = right.groupBy("category").agg(F.count("*").alias("predicted_correct"))
    out = scored.groupBy("category").agg(*sums()).join(made, "category", "full").join(good, "category", "left")
    return out.fillna(0)


def overall(counts: DataFrame) -> DataFrame:
    """One row: the sums of counts by category over all of them, with their ratios."""
    names = [c for c in counts.columns if c != "category"]
    return ratios(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]))


def ratios(counts: DataFrame) -> DataFrame:
    r = lambda a, b, n: F.try_divide(F.col(a), F.col(b)).alias(n)
    more = [r("predicted_correct", "predicted", "precision")] if "predicted" in counts.columns else []
    return counts.select("*", r("caught", "gold", "recall"), r("full", "gold", "full_recall"), r("covered_chars", "gold_chars", "char_recall"), *more)


def by_value(scored: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """Counts by a document column (domain, mode), empty values left out."""
    return scored.join(docs.select("doc_id", column).hint("merge"), "doc_id").where(F.coalesce(column, F.lit("")) != "").groupBy(column).agg(*sums())


def by_tag(scored: DataFrame) -> DataFrame:
    return scored.select("*", F.explode("tags").alias("tag")).groupBy("tag").agg(*sums())


def leaking(scored: DataFrame) -> DataFrame:
    """Documents in which an identifier is wholly untouched."""
    return scored.where("covered = 0").select("doc_id").distinct()


def over_redaction(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: clean_chars, clean_redacted, over_redaction (0 without clean characters).

    Clean is what isn't blank and outside every gold span; the measure is of (predictions minus gold), never by character: a
    document's gold spans are made disjoint beside its text, and lengths without blanks are added and taken away. Predictions
    are disjoint.
    """
    ink = lambda s, e: F.length(F.regexp_replace(between(F.col("text"), s, e), r"(?U)\s", ""))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    ends = lambda df, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(name))
    x = docs.select("doc_id", "text").join(ends(gold, "g").hint("merge"), "doc_id", "left").join(ends(predicted, "p").hint("merge"), "doc_id", "left")
    x = x.select("text", F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    start = F.expr("named_struct('at', 0, 'kept', cast(array() as array<struct<start: int, end: int>>))")
    rest = lambda acc, s: F.struct(F.greatest(acc["at"], s["start"]).alias("start"), s["end"].alias("end"))
    step = lambda acc, s: F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.array(rest(acc, s))).alias("kept"))).otherwise(acc)
    x = x.select("text", "p", F.aggregate("g", start, step, lambda acc: acc["kept"]).alias("g"))
    total = lambda spans: F.aggregate(spans, F.lit(0), lambda n, s: n + ink(s["start"], s["end"]))
    hit = lambda p: F.filter("g", lambda g: overlap(g["start"], g["end"], p["start"], p["end"]))
    both = F.aggregate("p", F.lit(0), lambda n, p: n + F.aggregate(hit(p), F.lit(0), lambda k, g: k + ink(F.greatest(g["start"], p["start"]), F.least(g["end"], p["end"]))))
    row = x.select((F.length(F.regexp_replace("text", r"(?U)\s", "")) - total("g")).alias("clean"), (total("p") - both).alias("redacted"))
    row = row.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("clean_chars"), F.coalesce(F.sum("redacted"), F.lit(0)).alias("clean_redacted"))
    return row.withColumn("over_redaction", F.coalesce(F.try_divide("clean_redacted", "clean_chars"), F.lit(0.0)))


def misses(scored: DataFrame, docs: DataFrame, n: int, around: int = 30) -> DataFrame:
    """First n spans not wholly covered, in document and span order, with their context on one line."""
    first = scored.where("NOT full").orderBy("doc_id", "gold_id").limit(n)
    context = F.regexp_replace(F.substr("text", F.greatest(F.col("start") - around, F.lit(0)) + 1, F.col("end") - F.col("start") + around + F.least(F.col("start"), F.lit(around))), "\n", " ")
    found = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")  # n rows
    return found.select("doc_id", "gold_id", "category", "label", F.col("caught").alias("partial"), context.alias("context")).orderBy("doc_id", "gold_id")


def response_matrix(scored_by_system: DataFrame, systems: list[str]) -> DataFrame:
    """item with one outcome column for each system, null where a system has none."""
    of = lambda s: F.first(F.when(F.col("system") == s, F.col("outcome")), ignorenulls=True).alias(s)
    return scored_by_system.groupBy("item").agg(*map(of, systems))


def sweep(gold: DataFrame, hits: DataFrame, docs: DataFrame, thresholds: DataFrame, strict: bool = False) -> DataFrame:
    """Leaks and recall at each threshold; hits(doc_id, start, end, category, confidence) are made once for all of them.

    thresholds(threshold) are all swept, as one array that is sent to every task: spans are measured against all hits once, and each
    threshold adds up those at or above it.
    """
    t = thresholds.select("threshold").where("threshold IS NOT NULL").distinct().agg(F.array_sort(F.collect_list("threshold")).alias("thresholds"))
    spans = in_policy(gold, strict).groupBy("doc_id").agg(F.collect_list(F.struct("gold_id", "start", "end", "category")).alias("g"))
    made = hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "confidence")).alias("made"))
    x = docs.select("doc_id", "text").join(spans.hint("merge"), "doc_id").join(made.hint("merge"), "doc_id", "left").crossJoin(F.broadcast(t))  # one row of thresholds
    none = F.expr("cast(array() as array<struct<start: int, end: int, confidence: double>>)")

    def measure(g: Column) -> Column:
        part = between(F.col("text"), g["start"], g["end"])
        near = F.filter(F.coalesce("made", none), lambda p: overlap(g["start"], g["end"], p["start"], p["end"]))
        bytes_ = F.transform(near, lambda p: F.struct(p["confidence"].alias("confidence"), F.octet_length(between(F.col("text"), F.greatest(g["start"], p["start"]), F.least(g["end"], p["end"]))).alias("n")))
        old = F.coalesce(F.regexp_replace(part, "[^0-9]", "").try_cast("long") >= 90, F.lit(False))
        return F.struct(g["gold_id"].alias("gold_id"), g["category"].alias("category"), F.octet_length(part).alias("size"), F.octet_length(F.regexp_replace(part, r"(?U)\s", "")).alias("body"), bytes_.alias("bytes"), old.alias("old"))

    found = x.select("doc_id", "thresholds", F.inline(F.transform("g", measure))).where("category <> 'AGE' OR old")
    each = found.select("doc_id", "gold_id", "size", "body", "bytes", F.explode("thresholds").alias("threshold"))
    covered = F.aggregate(F.filter("bytes", lambda p: p["confidence"] >= F.col("threshold")), F.lit(0), lambda n, p: n + p["n"])
    scored = judged(each.select("doc_id", "gold_id", "size", "body", "threshold", covered.alias("covered")))
    return scored.groupBy("threshold").agg(*sums(), F.countDistinct(F.when(F.col("covered") == 0, F.col("doc_id"))).alias("leak_docs"))


def numbered_gold(docs: DataFrame, column: str = "gold") -> DataFrame:
    """gold of docs(doc_id, <column> array<struct<start, end, label, tags>>), numbered before any filter."""
    return docs.select("doc_id", F.posexplode(column).alias("gold_id", "g")).select("doc_id", "gold_id", "g.start", "g.end", "g.label", "g.tags")

