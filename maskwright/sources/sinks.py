"""Writers of redacted texts, converted documents, scores and reports."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import map_label
from ..operators.evaluate import overall, ratios
from ..operators.render import tag_redacted


def write_redacted(rendered: DataFrame, path: str) -> None:
    """JSON lines of texts with their items."""
    rendered.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def scrubbed(detected: DataFrame, threshold: float, text: str = "text") -> DataFrame:
    """(json) of detected documents: the redacted text, its items, spans that are only possible, and the threshold."""
    item = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), F.concat(F.lit("["), s["category"], F.lit("]")).alias("replacement"))
    maybe = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["confidence"].alias("confidence"))
    x = tag_redacted(detected, "doc_id", text)
    return x.select("doc_id", F.to_json(F.struct(F.col("redacted").alias("text"), F.transform("spans", item).alias("items"), F.transform("possible", maybe).alias("possible"), F.lit(threshold).alias("threshold"))).alias("json"))


def summary(detected: DataFrame) -> DataFrame:
    """(category, replaced, possible): how many spans were replaced, and how many only look like identifiers."""
    kinds = F.concat(F.transform("spans", lambda s: F.struct(s["category"].alias("category"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("possible", lambda s: F.struct(s["category"].alias("category"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return detected.select(F.inline(kinds)).groupBy("category").agg(F.sum("a").alias("replaced"), F.sum("b").alias("possible"))


def converted(docs: DataFrame, strict: bool = False) -> DataFrame:
    """docs(doc_id, text, gold) with labels mapped; spans that are no identifiers are dropped and counted."""
    mapped = F.transform("gold", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), map_label(g["label"]).alias("label")))
    keep = (lambda g: g["label"] != "KEEP") if strict else (lambda g: ~g["label"].isin("KEEP", "QUASI"))
    x = docs.withColumn("mapped", mapped)
    return x.select("doc_id", "text", F.filter("mapped", keep).alias("spans"), (F.size("mapped") - F.size(F.filter("mapped", keep))).alias("dropped"))


def write_converted(docs: DataFrame, path: str, strict: bool = False) -> DataFrame:
    """Write converted documents as JSON lines; returns (kept, dropped) counts."""
    x = converted(docs, strict)
    x.select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text", "spans")).alias("value")).write.text(path)
    return x.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


def write_responses(scored: DataFrame, path: str) -> None:
    scored.select("item", "outcome").write.csv(path, header=True)


def write_by_config(scored: DataFrame, path: str) -> None:
    """Scores of several configurations, a folder for each."""
    scored.write.partitionBy("config").json(path)


def boxes_json(boxes: DataFrame) -> DataFrame:
    """(doc_id, json) {"boxes": [{"page", "box"}]} in page and reading order."""
    box = F.struct("page", "line", "word", F.array("x", "y", "w", "h").alias("box"))
    rows = boxes.groupBy("doc_id").agg(F.sort_array(F.collect_list(box)).alias("b"))
    return rows.select("doc_id", F.to_json(F.struct(F.transform("b", lambda b: F.struct(b["page"].alias("page"), b["box"].alias("box"))).alias("boxes"))).alias("json"))


def number(v: object, digits: int = 1) -> str:
    return "–" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def markdown(table: DataFrame, order: list[str], limit: int | None = None) -> str:
    """A small table (its first rows, where there is a limit) as markdown, missing ratios as a dash."""
    rows = table.orderBy(*order)
    rows = (rows if limit is None else rows.limit(limit)).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(number(v) for v in r) + " |" for r in rows)])


def comparison(counts: DataFrame, by: str, systems: list[str], measure: str = "recall") -> DataFrame:
    """counts(system, by, gold, caught, full, …) as one row for each value of `by` and a column for each system."""
    return ratios(counts).groupBy(by).pivot("system", systems).agg(F.first(measure)).orderBy(by)


def results_markdown(tables: dict[str, DataFrame], systems: list[str]) -> str:
    """Comparisons of systems by each of some columns (domain, mode, tag, category), a heading and a table for each."""
    return "\n\n".join(f"## By {by}\n\n{markdown(comparison(counts, by, systems), [by])}" for by, counts in tables.items())


def counted(by_category: DataFrame) -> DataFrame:
    """The counts by category, made once: what a report asks of them is a row for each category."""
    return by_category.sparkSession.createDataFrame(by_category.collect(), by_category.schema)


def report_lines(by_category: DataFrame, misses: DataFrame | None = None) -> list[str]:
    """A report in columns of fixed width: categories, all of them together, and what was missed."""
    by_category = counted(by_category)
    names = ["gold", "caught", "full", "predicted"]
    rates = ["recall", "full_recall", "char_recall", "precision"]
    rows = [(r["category"], r) for r in ratios(by_category).orderBy("category").collect()] + [("ALL", overall(by_category).collect()[0])]
    cell = lambda v: "–" if v is None else f"{100 * v:.1f}%"
    head = f"{'category':<12}" + "".join(f"{n:>11}" for n in (*names, *rates))
    body = [f"{c:<12}" + "".join(f"{r[n]:>11}" for n in names) + "".join(f"{cell(r[n]):>11}" for n in rates) for c, r in rows]
    missed = [f"{'partly' if m['partial'] else 'missed'} {m['category']} in {m['doc_id']}: {m['context']}" for m in (misses.orderBy("doc_id", "gold_id").collect() if misses is not None else [])]
    return [head, *body, *missed]


def report_json(by_category: DataFrame, misses: DataFrame | None = None) -> str:
    rows = lambda df: [{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.asDict().items()} for r in df.collect()]
    by_category = counted(by_category)
    return json.dumps({"overall": rows(overall(by_category))[0], "categories": rows(ratios(by_category).orderBy("category")), "misses": rows(misses.orderBy("doc_id", "gold_id")) if misses is not None else []}, indent=1)


def scorecard(name: str, sets: DataFrame, gates: DataFrame) -> dict:
    """A battery's scores and gates, which pass together or not at all."""
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    g = rows(gates, "gate", "set", "system")
    return {"name": name, "pass": all(x["pass"] for x in g), "sets": rows(sets, "set", "system"), "gates": g}


def scorecard_markdown(card: dict) -> str:
    line = lambda values: "| " + " | ".join(values) + " |"
    percent = lambda v: "–" if v is None else f"{100 * v:.2f}%"
    out = [f"# Scorecard: {card['name']}", "", line(["set", "docs", "system", "recall", "full", "leaking docs", "over-redaction", "precision"]), "|" + "---|" * 8]
    out += [line([s["set"], str(s["docs"]), s["system"], percent(s["recall"]), percent(s["full"]), f"{s['leak_docs']} ({percent(s['leak_rate'])})", percent(s["over_redaction"]), percent(s["precision"])]) for s in card["sets"]]
    out += ["", "## Gates", "", line(["gate", "set", "system", "actual", "limit", "result"]), "|" + "---|" * 6]
    out += [line([g["gate"], g["set"], g["system"], f"{g['actual']:.4f}", f"{g['limit']:.4f}", "pass" if g["pass"] else "**fail**"]) for g in card["gates"]]
    return "\n".join([*out, "", f"Verdict: {'pass' if card['pass'] else 'fail'}", ""])


def items_table(items: DataFrame, fitted: DataFrame, tags: DataFrame) -> DataFrame:
    """(item, a, b, p, tags) of every item, as text: fitted parameters where it tells systems apart, else the tag non-informative."""
    own = tags.groupBy("item").agg(F.collect_set("tag").alias("t"))
    x = items.select("item", F.col("p").alias("__p")).join(fitted.select("item", "a", "b"), "item", "left").join(own, "item", "left")
    known = F.coalesce("t", F.array().cast("array<string>"))
    all_ = F.when(F.col("a").isNull(), F.array_append(known, F.lit("non-informative"))).otherwise(known)
    text = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit(""))
    return x.select("item", F.when(F.col("a").isNull(), "").otherwise(text("a")).alias("a"), F.when(F.col("b").isNull(), "").otherwise(text("b")).alias("b"), text("__p").alias("p"), F.array_join(F.array_sort(all_), "|").alias("tags"))


def write_items(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)


def irt_markdown(systems: DataFrame, tags: DataFrame, n_items: int, n_informative: int) -> str:
    """Abilities of systems(system, theta, se, p), then difficulties of tags(tag, n, mean_b, sd_b, mean_p), easiest first."""
    out = ["# Item analysis", "", f"{n_items} items, {n_informative} of them tell systems apart.", "", "| system | theta | se | p |", "|---|---|---|---|"]
    out += [f"| {r['system']} | {r['theta']:+.2f} | {r['se']:.2f} | {r['p']:.3f} |" for r in systems.orderBy("system").collect()]
    out += ["", "| tag | n | mean b | sd b | mean p |", "|---|---|---|---|---|"]
    return "\n".join([*out, *(f"| {r['tag']} | {r['n']} | {r['mean_b']:+.2f} | {r['sd_b']:.2f} | {r['mean_p']:.3f} |" for r in tags.orderBy("mean_b", "tag").collect()), ""])


def sweep_json(sweep: DataFrame) -> str:
    """Sweep rows as JSON, missing ratios as null."""
    rows = [r.asDict() for r in sweep.orderBy("threshold").collect()]
    return json.dumps([{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()} for r in rows], indent=1)


def manifest(sources: dict[str, DataFrame], key: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """(source, rows, digest, share, seed): what a mix was made of; the digest is a sha256 over the sum of all keys' sha256
    (60 bits of each), so it doesn't depend on order and is summed where the rows are."""
    one_key = F.conv(F.substr(F.sha2(F.col(key).cast("string"), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    out = None
    for name, df in sources.items():
        one = df.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum(one_key), F.lit(0)).cast("string"), 256).alias("digest")).select(F.lit(name).alias("source"), "rows", "digest", F.lit(float(shares[name])).alias("share"), F.lit(seed).alias("seed"))
        out = one if out is None else out.unionByName(one)
    return out
