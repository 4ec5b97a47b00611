"""Readers of labelled documents, predictions, markup, responses, sweeps, reports and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXT_KEYS, SPAN_KEYS, LABEL_KEYS = ("text", "source_text", "full_text", "document"), ("spans", "entities", "privacy_mask", "labels"), ("label", "entity_type", "type", "entity")
RAW_SPANS = "array<struct<start: string, end: string, label: string, entity_type: string, type: string, entity: string, kind: string, tags: array<string>>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a file, blank ones left out, numbered from 1 in file order."""
    low = (1 << 33) - 1  # an id is the partition's number and, in its low 33 bits, the row's in the partition
    lines = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    lines = lines.select(F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit(low)).alias("__at"), "value")
    sizes = lines.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each part of the input
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return lines.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at") + 1).alias("line"), "value").where(F.trim("value") != "")


def read_note(spark: SparkSession, stream) -> DataFrame:
    """(doc_id, text) of all that an open stream holds, as one note."""
    return spark.createDataFrame([("doc1", stream.read())], "doc_id string, text string")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of a file that aren't blank, as they are."""
    return numbered_lines(spark, path).orderBy("line").limit(n)


def string_at(parsed: Column, key: str) -> Column:
    """A member of a JSON object that try_parse_json() gave, if it is a string."""
    v = F.variant_get(parsed, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def parse_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, line, text, domain, mode, gold) of JSON lines with any of the usual key names.

    A line without text fails. Spans come from the first key present, as an array or as JSON in a string; spans need whole
    numbers and start < end; an id that is no string, or empty, is "doc" and the line's number.
    """
    lines = lines.withColumn("__v", F.try_parse_json("value"))  # once for all members
    text = F.coalesce(*[string_at(F.col("__v"), k) for k in TEXT_KEYS])
    raw = F.col("__raw")
    spans = F.coalesce(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, RAW_SPANS)), F.expr(f"cast(array() as {RAW_SPANS})"))
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("int"))
    clean = F.transform(spans, lambda s: F.struct(number(s["start"]).alias("start"), F.least(number(s["end"]), F.length("text")).alias("end"), F.coalesce(*[s[k] for k in LABEL_KEYS], F.lit("")).alias("label"), F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags")))
    out = lines.withColumns({"text": text, "__raw": F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in SPAN_KEYS], F.lit("[]"))})
    sound = F.assert_true(F.col("text").isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": no text field")))
    own = string_at(F.col("__v"), "id")
    doc_id = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.concat(F.lit("doc"), F.col("line").cast("string")))
    kept = F.filter(clean, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] < s["end"]))
    return out.where(sound.isNull()).select(doc_id.alias("doc_id"), "line", "text", F.coalesce(string_at(F.col("__v"), "domain"), F.lit("")).alias("domain"), F.coalesce(string_at(F.col("__v"), "mode"), F.lit("")).alias("mode"), kept.alias("gold"))


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    docs = parse_documents(numbered_lines(spark, path))
    return docs.orderBy("line").limit(limit) if limit else docs


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, spans); a repeated id fails."""
    rows = parse_documents(numbered_lines(spark, path))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    sound = F.assert_true(F.col("n") == 1, F.concat(F.lit("duplicate id "), F.col("doc_id")))
    return rows.join(counts.where(sound.isNull()), "doc_id").select("doc_id", "text", F.col("gold").alias("spans"))


MARKED = r"\{\{([A-Za-z0-9_]+)\|([\s\S]*?)\}\}"


def parse_markup(texts: DataFrame, column: str = "raw") -> DataFrame:
    """texts with `text` and `spans` of {{label|text}} markup: plain and marked pieces summed by length, natively."""
    piece = F.expr(f"regexp_extract_all({column}, '(?s)(.*?)(?:\\\\{{\\\\{{([A-Za-z0-9_]+)\\\\|(.*?)\\\\}}\\\\}}|\\\\z)', 0)")
    whole = r"(?s)^(.*?)(?:\{\{([A-Za-z0-9_]+)\|(.*?)\}\})?$"
    part = F.transform(piece, lambda p: F.struct(F.when(p.rlike(r"\{\{[A-Za-z0-9_]+\|[\s\S]*?\}\}$"), F.regexp_extract(p, whole, 1)).otherwise(p).alias("plain"), F.when(p.rlike(r"\{\{[A-Za-z0-9_]+\|[\s\S]*?\}\}$"), F.regexp_extract(p, whole, 2)).alias("label"), F.when(p.rlike(r"\{\{[A-Za-z0-9_]+\|[\s\S]*?\}\}$"), F.regexp_extract(p, whole, 3)).otherwise("").alias("value")))
    x = texts.withColumn("__p", part)
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int, label: string>>))")
    at = lambda acc, p: acc["at"] + F.length(p["plain"])
    step = lambda acc, p: F.struct((at(acc, p) + F.length(p["value"])).alias("at"), F.when(p["label"].isNotNull(), F.concat(acc["spans"], F.array(F.struct(at(acc, p).alias("start"), (at(acc, p) + F.length(p["value"])).alias("end"), p["label"].alias("label"))))).otherwise(acc["spans"]).alias("spans"))
    return x.withColumn("text", F.array_join(F.transform("__p", lambda p: F.concat(p["plain"], p["value"])), "")).withColumn("spans", F.aggregate("__p", start, step, lambda acc: acc["spans"])).drop("__p")


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text, spans): documents of a file are parted by lines of ---."""
    whole = spark.read.text(path, wholetext=True)
    docs = whole.select(F.posexplode(F.split("value", r"(?m)^---[ \t]*$\n?")).alias("doc", "raw")).withColumn("raw", F.trim("raw")).where(F.regexp_replace("raw", r"\s", "") != "")
    return parse_markup(docs.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", ""))).drop("raw")


def clean_reply(text: Column) -> Column:
    """A model's reply without its thinking; empty where a thought isn't closed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s*thought\b\s*", "")
    return F.when(bare.contains("<think>"), "").otherwise(F.trim(bare))


def parse_reply_markup(replies: DataFrame, labels: list[str]) -> DataFrame:
    """Replies with upper-case markup, dropped where a label is unknown, braces are left or nothing is marked."""
    x = parse_markup(replies.withColumn("raw", clean_reply(F.col("raw"))))
    return x.where((F.size("spans") > 0) & F.forall("spans", lambda s: s["label"].isin(labels)) & ~F.col("text").rlike(r"\{\{|\}\}"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(item, system, outcome) of a CSV with a column for each system; blank is null."""
    wide = spark.read.csv(path, header=True)
    return wide.unpivot(["item"], [c for c in wide.columns if c != "item"], "system", "outcome").withColumn("outcome", F.col("outcome").cast("int"))


SWEEP = "threshold double, model_default boolean, recall double, full double, chars double, precision double, leak_docs bigint, over_redaction double, gold_chars bigint, clean_chars bigint"


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SWEEP).json(path, multiLine=True)


POLICY = "domain string, title string, basis array<struct<cite: string, summary: string>>, identifiers array<struct<category: string, kinds: array<string>, treatment: string>>, strict boolean, caveats array<string>, note string"


SCORECARD = "name string, pass boolean, sets array<struct<set: string, system: string, docs: bigint, recall: double, full: double, leak_docs: bigint, leak_rate: double, over_redaction: double, precision: double>>, gates array<struct<gate: string, set: string, system: string, actual: double, limit: double, pass: boolean>>"


def read_scorecard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORECARD).json(path, multiLine=True)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY).json(path, multiLine=True)


def read_results_table(spark: SparkSession, path: str) -> DataFrame:
    """(system, recall, full, leak, over_red, precision) of a report's headline table."""
    row = r"^\|\s*([^|]+?)\s*\|" + r"\s*\**([0-9.]+)\s*%?\**\s*\|" * 5
    lines = spark.read.text(path)
    return lines.where(F.col("value").rlike(row)).select(F.regexp_extract("value", row, 1).alias("system"), *[F.regexp_extract("value", row, i).cast("double").alias(n) for i, n in enumerate(("recall", "full", "leak", "over_red", "precision"), 2)])


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a newline file, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def normal_spans(rows: DataFrame, text: str | None = None, spans: str | None = None, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Foreign datasets' rows as (text, spans): spans as an array or a string, those without label or ends dropped.

    Columns are the first that bear a usual name, unless given; a string is read as JSON, or else as Python's notation. With a
    limit, that many rows are taken in an order by hash of seed and text.
    """
    text, spans = text or next(c for c in TEXT_KEYS if c in rows.columns), spans or next(c for c in SPAN_KEYS if c in rows.columns)
    if limit is not None:
        rows = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), text), 256), text).limit(limit)
    kind = rows.schema[spans].dataType.typeName()
    python = F.regexp_replace(F.regexp_replace(spans, r"(?<=[\[{,: ])'((?:[^'\\\\]|\\\\.)*)'(?=\s*[\]},:])", '"$1"'), r"\bNone\b", "null")
    array = F.coalesce(F.from_json(spans, RAW_SPANS), F.from_json(python, RAW_SPANS)) if kind == "string" else F.from_json(F.to_json(spans), RAW_SPANS)
    label = lambda s: F.coalesce(*[s[k] for k in LABEL_KEYS])
    kept = F.filter(array, lambda s: label(s).isNotNull() & s["start"].isNotNull() & s["end"].isNotNull())
    return rows.select(F.col(text).alias("text"), F.transform(kept, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), label(s).alias("label"))).alias("spans"))
