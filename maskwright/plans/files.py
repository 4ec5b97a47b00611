"""Registered queries over readers and writers: what is written is read back."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import register as sql_functions
from ..operators import detect, evaluate, ocr, stats, synth, windows
from ..operators.formats import format_column, format_regex, format_sql
from ..sources import readers, sinks
from ..sources.paths import fresh_path
from .catalogue import SCORED, dealt, query, read, scored
from .notes import WITH_NOTES, tables


def written(spark, name, values):
    """The path of a text file of values (value string)."""
    path = fresh_path(spark, name)
    values.write.text(path)
    return path


def keys(spark, sf_dir):
    return dealt(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "k")


# --- documents and predictions ---------------------------------------------------------------------------------------

_TEXT, _SPANS, _LABEL = (["text", "source_text", "full_text", "document"], ["spans", "entities", "privacy_mask", "labels"], ["label", "entity_type", "type", "entity"])


@query("""SELECT CASE WHEN k % 5 = 0 THEN 'doc' || CAST(k AS VARCHAR) ELSE 'n' || CAST(k AS VARCHAR) END AS doc_id, 'Note ' || CAST(k AS VARCHAR) AS text, CASE WHEN k % 2 = 0 THEN 'legal' ELSE '' END AS domain, 5 AS span_start, (5 + length(CAST(k AS VARCHAR)))::INT AS span_end, 'mrn' AS label, CASE WHEN k % 3 = 0 THEN 'cue' ELSE '' END AS tags FROM (SELECT c_custkey AS k FROM customer) WHERE k % 7 <> 0""")
def parsed_documents(spark, sf_dir):
    """JSON lines under all key names, spans as arrays or as JSON in a string, with spans that don't count."""
    k = F.col("k")
    end = 5 + F.length(k.cast("string"))
    good = F.concat(F.lit('{"start": 5, "end": '), end.cast("string"), F.lit(', "'), F.element_at(F.array(*map(F.lit, _LABEL)), (k % 4 + 1).cast("int")), F.lit('": "mrn"'), F.when(k % 3 == 0, ', "tags": ["cue"]').otherwise(""), F.lit("}"))
    spans = F.when(k % 7 == 0, '{"start": 1}').otherwise(F.concat(F.lit('[{"start": -1, "end": 3}, {"start": 4, "end": 4}, '), good, F.lit(', {"start": "x", "end": 9}]')))
    spans = F.when(k % 4 == 3, F.to_json(F.struct(spans.alias("s")))).otherwise(F.concat(F.lit('{"s":'), spans, F.lit("}")))
    body = F.regexp_extract(spans, r'^\{"s":([\s\S]*)\}$', 1)
    own = F.when(k % 5 == 0, "7").otherwise(F.concat(F.lit('"n'), k.cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"id": '), own, F.lit(', "'), F.element_at(F.array(*map(F.lit, _TEXT)), (k % 4 + 1).cast("int")), F.lit('": "Note '), k.cast("string"), F.lit('", "'), F.element_at(F.array(*map(F.lit, _SPANS)), (k % 4 + 1).cast("int")), F.lit('": '), body, F.when(k % 2 == 0, ', "domain": "legal"').otherwise(""), F.lit("}"))
    docs = readers.parse_documents(keys(spark, sf_dir).select(k.alias("line"), line.alias("value")))
    rows = docs.select("doc_id", "text", "domain", F.inline_outer("gold")).where("start IS NOT NULL")  # an inner inline would parse twice
    return rows.select("doc_id", "text", "domain", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'doc' || CAST(n + (n - 1) // 3 AS VARCHAR) AS doc_id, 'line ' || lpad(CAST(n AS VARCHAR), 6, '0') AS text FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n <= 20")
def first_documents(spark, sf_dir):
    """The first documents of a file with blank lines, numbered by their lines."""
    n = keys(spark, sf_dir).count()
    rows = spark.range(1, n + 1, 1, 1).select(F.explode(F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit('{"text": "line '), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit('"}')), F.lit("  "))).otherwise(F.array(F.concat(F.lit('{"text": "line '), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit('"}'))))).alias("value"))
    return readers.read_documents(spark, written(spark, "lines", rows), 20).select("doc_id", "text")


@query("SELECT 'n' || CAST(c_custkey AS VARCHAR) AS doc_id, 'Note ' || CAST(c_custkey AS VARCHAR) AS text, 1::BIGINT AS n_spans FROM customer")
def read_predictions(spark, sf_dir):
    line = F.to_json(F.struct(F.concat(F.lit("n"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("Note "), F.col("k").cast("string")).alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("id").alias("label"))).alias("spans")))
    out = readers.read_predictions(spark, written(spark, "predictions", keys(spark, sf_dir).select(line.alias("value"))))
    return out.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_spans"))


@query("SELECT 'Seen ' || CAST(c_custkey AS VARCHAR) || ' of Ann Lee.' AS text, 5 AS first_start, (5 + length(CAST(c_custkey AS VARCHAR)))::INT AS first_end, (9 + length(CAST(c_custkey AS VARCHAR)))::INT AS last_start, 'mrn,name' AS labels FROM customer")
def marked_notes(spark, sf_dir):
    doc = F.concat(F.lit("Seen {{mrn|"), F.col("k").cast("string"), F.lit("}} of {{name|Ann Lee}}.\n---"))
    out = readers.read_markup(spark, written(spark, "markup", keys(spark, sf_dir).select(doc.alias("value"))))
    return out.select("text", F.get("spans", F.lit(0))["start"].alias("first_start"), F.get("spans", F.lit(0))["end"].alias("first_end"), F.get("spans", F.lit(1))["start"].alias("last_start"), F.array_join(F.transform("spans", lambda s: s["label"]), ",").alias("labels"))


@query("SELECT c_custkey AS k, 'Call ' || CAST(c_custkey AS VARCHAR) || ' now' AS text FROM customer WHERE c_custkey % 5 = 0")
def marked_replies(spark, sf_dir):
    """Of replies, those that are kept: thoughts are cut off; unknown labels, open braces and plain texts are dropped."""
    k = F.col("k")
    n = k.cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("<think>hm {{X|y}}</think> Call {{PHONE|"), n, F.lit("}} now"))).when(k % 5 == 1, F.concat(F.lit("Call {{FOO|"), n, F.lit("}} now"))).when(k % 5 == 2, "Call {{PHONE|1}} now {{").when(k % 5 == 3, "Call now").otherwise("<think>never closed {{PHONE|1}}")
    return readers.parse_reply_markup(keys(spark, sf_dir).select("k", raw.alias("raw")), ["PHONE", "NAME"]).select("k", "text")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b c' WHEN 2 THEN '' ELSE 'plain' END AS reply FROM customer")
def clean_replies(spark, sf_dir):
    k = F.col("k") % 4
    raw = F.when(k == 0, "<think>x\ny</think> a ").when(k == 1, "thought b c").when(k == 2, "<think>open").otherwise("plain")
    return keys(spark, sf_dir).select("k", readers.clean_reply(raw).alias("reply"))


@query("SELECT 'Ann ' || CAST(c_custkey AS VARCHAR) || ', it''s' AS text, 4 AS span_start, (4 + length(CAST(c_custkey AS VARCHAR)))::INT AS span_end, 'ID' AS label FROM customer")
def foreign_rows(spark, sf_dir):
    """Spans of other datasets as JSON or in Python's notation, quotes inside values included."""
    n = F.col("k").cast("string")
    end = (4 + F.length(n)).cast("string")
    json_ = F.concat(F.lit('[{"entity_type": "ID", "start": 4, "end": '), end, F.lit('}, {"start": 1, "end": 2}]'))
    python = F.concat(F.lit("[{'entity_type': 'ID', 'start': 4, 'end': "), end, F.lit(", 'kind': None}, {'label': 'X', 'start': None, 'end': 2}]"))
    rows = keys(spark, sf_dir).select(F.concat(F.lit("Ann "), n, F.lit(", it's")).alias("source_text"), F.when(F.col("k") % 2 == 0, json_).otherwise(python).alias("privacy_mask"))
    return readers.normal_spans(rows).select("text", F.inline("spans")).select("text", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label")


@query("SELECT c_custkey AS k FROM customer ORDER BY sha256('4|Ann ' || CAST(c_custkey AS VARCHAR)) LIMIT 30")
def foreign_sample(spark, sf_dir):
    rows = keys(spark, sf_dir).select(F.concat(F.lit("Ann "), F.col("k").cast("string")).alias("text"), F.lit("[]").alias("spans"))
    return readers.normal_spans(rows, seed=4, limit=30).select(F.substring_index("text", " ", -1).cast("bigint").alias("k"))


@query("SELECT DISTINCT c_mktsegment AS name FROM customer")
def name_pool(spark, sf_dir):
    k = read(spark, sf_dir, "customer", "c_mktsegment").distinct().select(F.explode(F.array(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), F.lit(""))).alias("value"))
    return readers.read_pool(spark, written(spark, "pool", k))


@query("SELECT n_name AS domain, n_regionkey = 1 AS strict, 'NAME' AS category, 'redact' AS treatment, 2::BIGINT AS kinds FROM nation")
def domain_policies(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_name", "n_regionkey")
    policy = F.struct(F.col("n_name").alias("domain"), F.lit("t").alias("title"), F.array(F.struct(F.lit("NAME").alias("category"), F.array(F.lit("full"), F.lit("part")).alias("kinds"), F.lit("redact").alias("treatment"))).alias("identifiers"), (F.col("n_regionkey") == 1).alias("strict"))
    path = fresh_path(spark, "policies")
    n.select(F.to_json(policy).alias("value"), F.col("n_name").alias("of")).write.partitionBy("of").text(path)
    out = readers.read_policies(spark, path)
    return out.select("domain", "strict", F.inline("identifiers")).select("domain", "strict", "category", "treatment", F.size("kinds").cast("bigint").alias("kinds"))


@query(f"{WITH_NOTES} SELECT note_id AS doc_id, count(*) AS n_spans, 0::BIGINT AS dropped FROM gold GROUP BY note_id")
def converted_notes(spark, sf_dir):
    docs, gold, _ = tables(spark, sf_dir)
    g = gold.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias("gold"))
    path = fresh_path(spark, "converted")
    out = docs.select("doc_id", "text").join(g, "doc_id")
    sinks.write_converted(out, path)
    back = readers.parse_documents(readers.numbered_lines(spark, path))
    # Texts meet by digest: what is sorted for the join is a few bytes of each.
    kept = back.select(F.size("gold").cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("digest"))
    return kept.join(out.select("doc_id", F.sha2("text", 256).alias("digest")), "digest").select("doc_id", "n_spans", F.lit(0).cast("bigint").alias("dropped"))


@query("SELECT (SELECT count(*) FROM customer) AS kept, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS dropped")
def converted_counts(spark, sf_dir):
    gold = F.array_compact(F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("mrn").alias("label")), F.when(F.col("k") % 4 == 0, F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("occupation").alias("label")))))
    rows = keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.lit("Note").alias("text"), gold.alias("gold"))
    return sinks.write_converted(rows, fresh_path(spark, "converted"))


# --- redacted texts, reports ------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS doc_id, 'MRN: [MRN] and kit QZ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' stays' AS text, 5::BIGINT AS item_start, 'MRN' AS category, 1::BIGINT AS n_possible, 0.35::DOUBLE AS threshold FROM customer")
def scrubbed_json(spark, sf_dir):
    n = F.lpad(F.col("k").cast("string"), 6, "0")
    docs = keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.concat(F.lit("MRN: 00"), n, F.lit(" and kit QZ"), n, F.lit(" stays")).alias("text"))
    out = sinks.scrubbed(detect.detect(docs), 0.35)
    path = fresh_path(spark, "scrubbed")
    sinks.write_redacted(out, path)
    back = spark.read.schema("doc_id bigint, json string").json(path)
    parsed = back.select("doc_id", F.from_json("json", "text string, items array<struct<start: bigint, end: bigint, category: string, replacement: string>>, possible array<struct<start: int>>, threshold double").alias("j"))
    return parsed.select("doc_id", "j.text", F.get("j.items", F.lit(0))["start"].alias("item_start"), F.get("j.items", F.lit(0))["category"].alias("category"), F.size("j.possible").cast("bigint").alias("n_possible"), "j.threshold")


@query("SELECT 'MRN' AS category, count(*) AS replaced, 0::BIGINT AS possible FROM customer UNION ALL SELECT 'ID', 0, count(*) FROM customer")
def scrub_summary(spark, sf_dir):
    n = F.lpad(F.col("k").cast("string"), 6, "0")
    docs = keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.concat(F.lit("MRN: 00"), n, F.lit(" and kit QZ"), n, F.lit(" stays")).alias("text"))
    return sinks.summary(detect.detect(docs))


@query(f"{SCORED} SELECT note_id || '#' || gold_id AS item, 'full' AS system, CASE WHEN full_ THEN 2 WHEN caught THEN 1 ELSE 0 END AS outcome FROM scored")
def responses_csv(spark, sf_dir):
    s = scored(spark, sf_dir)[0]
    path = fresh_path(spark, "responses")
    sinks.write_responses(s, path)
    return readers.read_responses(spark, path).select("item", F.lit("full").alias("system"), "outcome")


@query("SELECT config, category, n FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS config, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY ALL)")
def scores_by_config(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem", "l_linenumber", "l_returnflag")
    counts = x.groupBy(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("config"), F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"))
    path = fresh_path(spark, "configs")
    sinks.write_by_config(counts, path)
    return spark.read.json(path).select("config", "category", "n")


@query("SELECT l_quantity AS threshold, round(avg(l_discount), 6) AS recall, count_if(l_tax < 0.03)::BIGINT AS leak_docs FROM lineitem GROUP BY 1")
def sweep_file(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_tax").groupBy(F.col("l_quantity").alias("threshold")).agg(F.round(F.avg("l_discount"), 6).alias("recall"), F.count_if(F.col("l_tax") < 0.03).alias("leak_docs"))
    rows = spark.createDataFrame([(sinks.sweep_json(x),)], "value string").coalesce(1)
    return readers.read_sweep(spark, written(spark, "sweep", rows)).select("threshold", "recall", "leak_docs")


@query("SELECT n_name AS system, (n_nationkey + 0.5)::DOUBLE AS recall, (n_nationkey + 1.5)::DOUBLE AS \"full\", n_nationkey::DOUBLE AS leak, 0.2::DOUBLE AS over_red, 99.0::DOUBLE AS precision FROM nation")
def results_file(spark, sf_dir):
    k = F.col("n_nationkey")
    cell = lambda c, mark="": F.concat(F.lit("**" if mark else ""), F.format_string("%.1f", c.cast("double")), F.lit("%" if not mark else "%**"))
    row = F.concat_ws(" | ", F.lit("").substr(1, 0), F.col("n_name"), cell(k + 0.5, "b"), cell(k + 1.5), cell(k * 1.0), cell(F.lit(0.2)), cell(F.lit(99.0)), F.lit("20 |"))
    lines = read(spark, sf_dir, "nation", "n_name", "n_nationkey").select(F.explode(F.array(F.lit("# Report"), F.trim(row))).alias("value"))
    out = readers.read_results_table(spark, written(spark, "results", lines))
    return out


@query(f"{SCORED}, d AS (SELECT domain, s.* FROM scored s JOIN notes USING (note_id)) SELECT domain, round(count_if(caught) FILTER (gold_id % 2 = 0) / count(*) FILTER (gold_id % 2 = 0), 9) AS even, round(count_if(caught) FILTER (gold_id % 2 = 1) / count(*) FILTER (gold_id % 2 = 1), 9) AS odd FROM d GROUP BY domain")
def results_by_domain(spark, sf_dir):
    s, docs, _, _ = scored(spark, sf_dir)
    x = s.withColumn("system", F.when(F.col("gold_id") % 2 == 0, "even").otherwise("odd")).join(docs.select("doc_id", "domain"), "doc_id")
    counts = x.groupBy("system", "domain").agg(*evaluate.sums())
    return sinks.comparison(counts, "domain", ["even", "odd"]).select("domain", F.round("even", 9).alias("even"), F.round("odd", 9).alias("odd"))


@query(f"{SCORED}, s AS (SELECT category, count(*) AS gold, count_if(caught)::BIGINT AS caught FROM scored GROUP BY category), p AS (SELECT category, count(*) AS predicted FROM pred GROUP BY category), t AS (SELECT coalesce(s.category, p.category) AS category, coalesce(gold, 0) AS gold, coalesce(caught, 0) AS caught, coalesce(predicted, 0) AS predicted FROM s FULL JOIN p USING (category)) SELECT category, gold, caught, predicted FROM t UNION ALL SELECT 'ALL', sum(gold)::BIGINT, sum(caught)::BIGINT, sum(predicted)::BIGINT FROM t")
def report_text(spark, sf_dir):
    """A report in columns of fixed width, read back by its columns."""
    s, docs, gold, pred = scored(spark, sf_dir)
    lines = sinks.report_lines(evaluate.by_category(s, gold, pred))[1:]
    x = spark.createDataFrame([(v,) for v in lines], "value string")
    part = lambda i, n: F.trim(F.substring("value", i, n))
    return x.select(part(1, 12).alias("category"), part(13, 11).cast("bigint").alias("gold"), part(24, 11).cast("bigint").alias("caught"), part(46, 11).cast("bigint").alias("predicted"))


@query(f"{SCORED} SELECT count(*) AS gold, count_if(caught)::BIGINT AS caught, (SELECT count(*) FROM (SELECT 1 FROM scored WHERE NOT full_ ORDER BY note_id, gold_id LIMIT 10)) AS misses FROM scored")
def report_file(spark, sf_dir):
    s, docs, gold, pred = scored(spark, sf_dir)
    text = sinks.report_json(evaluate.by_category(s, gold, pred), evaluate.misses(s, docs, 10))
    x = spark.createDataFrame([(text,)], "json string").select(F.from_json("json", "overall struct<gold: bigint, caught: bigint>, misses array<struct<doc_id: bigint>>").alias("j"))
    return x.select("j.overall.gold", "j.overall.caught", F.size("j.misses").cast("bigint").alias("misses"))


GATED = "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'clin' ELSE 'tpl' END || n_regionkey AS set_, n_name AS system, (n_nationkey % 10) / 1000.0 AS leak, (n_nationkey % 15) / 1000.0 AS over FROM nation"


@query(f"WITH s AS ({GATED}) SELECT set_ AS set_name, system, over <= 0.01 AND (leak <= 0.005 OR set_ NOT LIKE 'clin%') AS passes, 'fail' AS verdict FROM s")
def scorecard_files(spark, sf_dir):
    """Gates and scores of systems as one JSON card, read back; its markdown names the verdict."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    base = n.select(F.concat(F.when(F.col("n_regionkey") % 2 == 0, "clin").otherwise("tpl"), F.col("n_regionkey").cast("string")).alias("set"), F.col("n_name").alias("system"), (F.col("n_nationkey") % 10 / 1000.0).alias("leak_rate"), (F.col("n_nationkey") % 15 / 1000.0).alias("over_redaction"), F.lit(0.9).alias("int8_recall"), F.lit(0.901).alias("fp32_recall"))
    sets = base.select("set", "system", F.lit(100).cast("bigint").alias("docs"), F.lit(0.9).alias("recall"), F.lit(0.8).alias("full"), (F.col("leak_rate") * 100).cast("bigint").alias("leak_docs"), "leak_rate", "over_redaction", F.lit(0.99).alias("precision"))
    card = sinks.scorecard("nightly", sets, stats.gates(base))
    verdict = sinks.scorecard_markdown(card).strip().rsplit(" ", 1)[-1]
    back = readers.read_scorecard(spark, written(spark, "card", spark.createDataFrame([(json.dumps(card),)], "value string")))
    gates = back.select(F.inline("gates")).groupBy(F.col("set").alias("set_name"), "system").agg(F.bool_and("pass").alias("passes"))
    return gates.withColumn("verdict", F.lit(verdict))


@query("""WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) || '#' || l_linenumber AS item, min(l_tax) AS p, min(l_partkey) % 3 AS m FROM lineitem GROUP BY 1)
SELECT item, CASE WHEN m = 0 THEN '' ELSE '1.250' END AS a, CASE WHEN m = 0 THEN '' ELSE '-0.500' END AS b, printf('%.3f', p) AS p, CASE m WHEN 0 THEN 'cue|non-informative' WHEN 1 THEN 'cue' ELSE 'cue|ocr' END AS tags FROM x""")
def items_csv(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_partkey")
    x = x.groupBy(F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item")).agg(F.min("l_tax").alias("p"), (F.min("l_partkey") % 3).alias("m"))
    fitted = x.where("m <> 0").select("item", F.lit(1.25).alias("a"), F.lit(-0.5).alias("b"))
    tags = x.select("item", F.lit("cue").alias("tag")).unionByName(x.where("m = 2").select("item", F.lit("ocr").alias("tag")))
    path = fresh_path(spark, "items")
    sinks.write_items(sinks.items_table(x.select("item", "p"), fitted, tags), path)
    back = spark.read.csv(path, header=True)
    return back.select("item", *[F.coalesce(c, F.lit("")).alias(c) for c in ("a", "b", "p", "tags")])


@query("SELECT tag, n, printf('%+.2f', mean_b) AS mean_b FROM (SELECT l_returnflag AS tag, count(*) AS n, avg(l_tax * 10) AS mean_b FROM lineitem GROUP BY 1)")
def item_report(spark, sf_dir):
    tags = read(spark, sf_dir, "lineitem", "l_returnflag", "l_tax").groupBy(F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"), F.avg(F.col("l_tax") * 10).alias("mean_b"), F.stddev_pop(F.col("l_tax") * 10).alias("sd_b"), F.avg("l_tax").alias("mean_p"))
    abilities = spark.createDataFrame([("a", 0.5, 0.1, 0.9)], "system string, theta double, se double, p double")
    text = sinks.irt_markdown(abilities, tags, 10, 7)
    rows = [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.count("|") == 6 and "---" not in line][1:]
    return spark.createDataFrame([(r[0], int(r[1]), r[2]) for r in rows], "tag string, n bigint, mean_b string")


@query("SELECT c_mktsegment AS source, count(*) AS rows_, sha256(CAST(sum(('0x' || left(sha256(CAST(c_custkey AS VARCHAR)), 15))::HUGEINT) AS VARCHAR)) AS digest FROM customer GROUP BY 1")
def mix_manifest(spark, sf_dir):
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    names = [r[0] for r in c.select("c_mktsegment").distinct().collect()]
    m = sinks.manifest({n: c.where(F.col("c_mktsegment") == n) for n in names}, "c_custkey", 3, dict.fromkeys(names, 0.2))
    return m.select("source", F.col("rows").alias("rows_"), "digest")


@query("SELECT n_nationkey AS doc_id, '{\"boxes\":[{\"page\":0,\"box\":[56.0,18.0,' || printf('%.1f', length(n_name) * 8 + 4.0) || ',14.0]}]}' AS json FROM nation WHERE instr(n_name, ' ') = 0")
def boxes_file(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name").where("instr(n_name, ' ') = 0")
    boxes = n.select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.lit(1).alias("word"), F.lit(56.0).cast("double").alias("x"), F.lit(18.0).cast("double").alias("y"), (F.length("n_name") * 8 + 4.0).cast("double").alias("w"), F.lit(14.0).cast("double").alias("h"))
    return sinks.boxes_json(boxes)


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'NAME' ELSE 'MRN' END AS category, count(*) AS spans, sum(1 + n_nationkey % 3)::BIGINT AS boxes FROM nation GROUP BY 1")
def redaction_report(spark, sf_dir):
    n = read(spark, sf_dir, "nation", "n_nationkey")
    spans = n.select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("seq"), F.when(F.col("n_nationkey") % 2 == 0, "NAME").otherwise("MRN").alias("category"))
    boxes = n.select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("seq"), F.explode(F.sequence(F.lit(0), (F.col("n_nationkey") % 3).cast("int"))).alias("b"))
    return ocr.report(boxes, spans)


# --- SQL functions, chunks, formats ------------------------------------------------------------------------------------


#: Rows of orders, each worth one short text, that a task gets at most.
ORDERS_A_TASK = 100_000


@query(f"SELECT o_orderkey, right(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 4) <> '0000' AND left(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), 3) NOT IN ('000', '666') AND lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[4:5] <> '00' AS ssn, {labels.label_sql('o_orderpriority')} AS label, year(o_orderdate::DATE)::INT AS year, 'MRN: [MRN_1].' AS tagged, 1::BIGINT AS n_spans FROM orders")
def sql_calls(spark, sf_dir):
    """The engine's functions called from SQL."""
    sql_functions.register(spark)
    orders = detect.dealt_by(read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderkey", rows=ORDERS_A_TASK)
    orders.createOrReplaceTempView("maskwright_orders")
    return spark.sql("""SELECT o_orderkey, valid_ssn(lpad(CAST(o_orderkey AS STRING), 9, '0')) AS ssn, map_label(o_orderpriority) AS label,
        year_of(date_format(o_orderdate, 'MM/dd/yyyy'), 2025) AS year, deid_tag(text) AS tagged, CAST(size(deid_spans(text)) AS BIGINT) AS n_spans
        FROM (SELECT *, concat('MRN: 00', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.') AS text FROM maskwright_orders)""")


@query("WITH w AS (SELECT c_custkey AS doc_id, i, 'w' || CAST((c_custkey + i) % 50 AS VARCHAR) AS t FROM customer, range(0, 30) r(i)), c AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY i) AS chunk FROM w, range(0, 3) s(k) WHERE i >= k * 12 AND i < k * 12 + 14 GROUP BY doc_id, k) SELECT doc_id, k::INT AS win, chunk FROM c")
def text_windows(spark, sf_dir):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("w"), ((F.col("k") + i) % 50).cast("string"))), " ")
    return windows.text_chunks(keys(spark, sf_dir).select(F.col("k").alias("doc_id"), words.alias("text")), 14).select("doc_id", "win", "chunk")


FORMATS = {"mrn": "{d8}", "plan": "{L3}-{d4}-{c}", "date": "{Mon} {do}, {yyyy}", "device": "SN{x4}{h2}", "name": "{fn} {fi}. {ln}", "any": "a{w3}{l2}{D1}{yy}{mm}{dd}{n}{a}"}


def _format_sql(engine_is_spark: bool) -> str:
    seed = "CAST(c_custkey AS STRING)"
    return " UNION ALL ".join(f"SELECT c_custkey AS k, '{n}' AS name, {format_sql(p, seed, engine_is_spark)} AS value FROM customer" for n, p in FORMATS.items())


@query(_format_sql(False).replace("AS STRING", "AS VARCHAR").replace("FROM customer", ", true AS own FROM customer"))
def format_values(spark, sf_dir):
    """Values of formats by their seeds, each of its own format."""
    k = keys(spark, sf_dir)
    one = lambda n, p: k.select("k", F.lit(n).alias("name"), format_column(p, F.col("k").cast("string")).alias("value")).withColumn("own", F.col("value").rlike(format_regex(p)))
    return reduce(lambda a, b: a.unionByName(b), (one(n, p) for n, p in FORMATS.items()))


NEW_FORMATS = {"a": "{d4}", "b": "{L4}", "c": "{L2}{d2}"}


@query("SELECT name, reason FROM (VALUES ('a', 'is of a training format'), ('MRN', '2 formats of 3'), ('ID', '1 formats of 3')) t(name, reason)")
def format_novelty(spark, sf_dir):
    found = synth.novel(NEW_FORMATS, ["{d4}"], labels={"a": "MRN", "b": "MRN", "c": "ID"})
    return spark.createDataFrame([(n, r.split(" ", 1)[1] if "training format" in r else r) for n, r in found.items()], "name string, reason string")


@query(f"{WITH_NOTES} SELECT note_id AS doc_id, start AS span_start, end_ AS span_end, label FROM gold WHERE label IN ('email', 'docket', 'name')")
def verbatim_places(spark, sf_dir):
    """Planted values found again in the texts, word by word."""
    docs, gold, _ = tables(spark, sf_dir)
    values = gold.where("label IN ('email', 'docket', 'name')").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.struct(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), "label").alias("v"))
    rows = values.groupBy("doc_id").agg(F.first("text").alias("text"), F.collect_list("v").alias("values"))
    found = synth.verbatim_places(rows).select("doc_id", F.inline("spans"))
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label")


@query("SELECT c_custkey AS doc_id, 'cue,fmt:new,novel_format' AS tags, true AS fits, 'x' AS kept FROM customer")
def revalued_items(spark, sf_dir):
    """Items of labels with new formats get new values and tags; others stay."""
    items = F.array(F.struct(F.lit("mrn").alias("label"), F.lit("12345678").alias("value"), F.array(F.lit("spoken"), F.lit("cue"), F.lit("fmt:old")).alias("tags")), F.struct(F.lit("org").alias("label"), F.lit("x").alias("value"), F.array(F.lit("cue")).alias("tags")))
    out = synth.revalued_items(keys(spark, sf_dir).select(F.col("k").alias("doc_id"), items.alias("planted")), {"mrn": [("new", "{L3}{d3}")]}, 1)
    first = F.get("planted", F.lit(0))
    return out.select("doc_id", F.array_join(F.array_sort(first["tags"]), ",").alias("tags"), first["value"].rlike("^[A-Z]{3}[0-9]{3}$").alias("fits"), F.get("planted", F.lit(1))["value"].alias("kept"))


@query("SELECT c_custkey AS doc_id, true AS holds, true AS fits FROM customer")
def carrier_notes(spark, sf_dir):
    """Notes of carrier, plain and hard sentences: every span holds a value of its label's format."""
    formats = [("mrn", "{d8}"), ("plan", "{L3}-{d4}")]
    n = keys(spark, sf_dir).count()
    notes = synth.carrier_notes(spark, n, 3, formats)
    value = lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"])
    fits = F.forall("spans", lambda s: F.when(s["label"] == "mrn", value(s).rlike(format_regex("{d8}"))).otherwise(value(s).rlike(format_regex("{L3}-{d4}"))))
    return notes.select("doc_id", (F.length("text") > 10).alias("holds"), fits.alias("fits"))


@query("SELECT c_custkey AS doc_id, 'R0om ' || CAST(c_custkey % 10 AS VARCHAR) AS noisy FROM customer")
def scan_noise(spark, sf_dir):
    k = keys(spark, sf_dir)
    x = k.select(F.col("k").alias("doc_id"), F.concat(F.lit("ROom "), (F.col("k") % 10).cast("string")).alias("text"))
    made = x.select("doc_id", "text", synth.scan_noise(F.col("text"), F.col("doc_id"), share=1.0).alias("n"))
    # Only one of the confusable characters is in the text: it is changed, or nothing is.
    return made.select("doc_id", F.when(F.col("n") == F.col("text"), F.regexp_replace("text", "O", "0")).otherwise(F.col("n")).alias("noisy"))

