"""Boxes of spans on scanned pages: words and lines of OCR output joined with spans of the page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap

BOX = "array<double>"
SCHEMA = f"pages array<struct<width: int, height: int, lines: array<struct<text: string, bbox: {BOX}, box: {BOX}, words: array<struct<text: string, start: int, end: int, box: {BOX}>>>>>>"
#: Pixels around a box, and the width or height below which a word's box is no box.
PAD, DEGENERATE = 2.0, 2.0


def parse(raw: DataFrame, column: str = "json") -> DataFrame:
    """Nested pages of OCR JSON; malformed text fails."""
    return raw.withColumn("doc", F.from_json(column, SCHEMA, {"mode": "FAILFAST"})).select("*", "doc.pages").drop("doc")


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, width, height): lines joined by line ends; blank pages left out."""
    p = pages.select("doc_id", F.posexplode("pages").alias("page", "p"))
    return p.select("doc_id", "page", F.array_join(F.transform("p.lines", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"), "p.width", "p.height").where(F.trim("text") != "")


def words(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, word, start, end, box, line_box, line_start, line_len, width, height) in positions of the page text.

    A word's stated place is taken if it holds the word, else the place of the word in its line that is nearest to it; lines
    may name their box `bbox` or `box`.
    """
    p = pages.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", "p.width", "p.height", F.col("p.lines").alias("lines"))
    sizes = F.transform("lines", lambda x: F.length(F.coalesce(x["text"], F.lit(""))) + 1)
    p = p.withColumn("starts", F.transform("lines", lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, n: s + n)))
    x = p.select("doc_id", "page", "width", "height", "starts", F.posexplode("lines").alias("line", "l"))
    x = x.select("doc_id", "page", "line", "width", "height", F.get("starts", F.col("line")).alias("line_start"), F.col("l.text").alias("line_text"), F.coalesce("l.bbox", "l.box").alias("line_box"), F.posexplode("l.words").alias("word", "w"))
    stated = F.substr("line_text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")) == F.col("w.text")
    gaps = F.split("line_text", F.concat(F.lit(r"\Q"), F.replace(F.col("w.text"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    place = lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda n, g: n + F.length(g)) + (k - 1) * F.length("w.text")
    places = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda k: F.struct(F.abs(place(k) - F.coalesce("w.start", F.lit(0))), place(k).alias("at")))
    nearest = F.when((F.size(gaps) > 1) & (F.length("w.text") > 0), F.array_min(places)["at"])
    at = F.when(stated, F.col("w.start")).otherwise(nearest)
    return x.withColumn("at", at).where("at IS NOT NULL").select("doc_id", "page", "line", "word", (F.col("line_start") + F.col("at")).alias("start"), (F.col("line_start") + F.col("at") + F.length("w.text")).alias("end"), F.col("w.box").alias("box"), "line_box", "line_start", F.length("line_text").alias("line_len"), "width", "height")


def boxes(words_: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, seq, x, y, w, h): a padded box, inside its page, of each word that a span overlaps.

    A degenerate word box gives way to the word's share of its line's box.
    """
    s = spans.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "seq", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = words_.join(s, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e")))
    b, line = (lambda i: F.get("box", F.lit(i))), (lambda i: F.get("line_box", F.lit(i)))
    flat = F.coalesce((b(2) < DEGENERATE) | (b(3) < DEGENERATE), F.lit(True)) & F.col("line_box").isNotNull()
    share = lambda pos: (pos - F.col("line_start")) / F.greatest(F.col("line_len"), F.lit(1))
    x = F.when(flat, line(0) + line(2) * share(F.col("start"))).otherwise(b(0))
    w = F.when(flat, line(2) * (share(F.col("end")) - share(F.col("start")))).otherwise(b(2))
    y, h = F.when(flat, line(1)).otherwise(b(1)), F.when(flat, line(3)).otherwise(b(3))
    left, top = F.greatest(x - PAD, F.lit(0.0)), F.greatest(y - PAD, F.lit(0.0))
    right, bottom = F.least(x + w + PAD, F.col("width").cast("double")), F.least(y + h + PAD, F.col("height").cast("double"))
    return hit.select("doc_id", "page", "seq", "line", "word", left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def report(boxes_: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans and boxes by category, without any text."""
    n = boxes_.groupBy("doc_id", "page", "seq").agg(F.count("*").alias("boxes"))
    return spans.join(n, ["doc_id", "page", "seq"], "left").groupBy("category").agg(F.count("*").alias("spans"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"))


def reading_order(lines: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Lines (doc_id, page, x, y, …) numbered from top to bottom by rows of `tolerance` pixels, then from left to right."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("doc_id", "page").orderBy(F.floor(F.col("y") / tolerance), "x")
    return lines.withColumn("n", F.row_number().over(by))


def redact_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, spans) of the identifiers that detection finds in the pages' texts."""
    from .detect import FIELDS, detect

    found = detect(page_texts(pages)).select("doc_id", "page", F.posexplode("spans").alias("seq", "s"))
    spans = found.select("doc_id", "page", "seq", *[F.col(f"s.{n}").alias(n) for n, _ in FIELDS])
    return boxes(words(pages), spans), spans
