"""Notes with planted identifiers, made of table rows by one SQL text that Spark and DuckDB share.

Gold spans hold by construction: a span starts where the pieces before it end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import dealt_by


def digits(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


K = "c_custkey"
#: Pieces of a note: (label of an identifier or None, SQL expression).
PIECES: list[tuple[str | None, str]] = [
    (None, "'MRN: '"),
    ("mrn", digits(K, 8)),
    (None, "'. Seen '"),
    ("date", f"{digits(f'{K} % 12 + 1', 2)} || '/' || {digits(f'{K} % 28 + 1', 2)} || '/2024'"),
    (None, "' in clinic. DOB: '"),
    ("dob", f"{digits(f'({K} + 3) % 12 + 1', 2)} || '/' || {digits(f'({K} + 5) % 28 + 1', 2)} || '/19' || {digits(f'30 + {K} % 60', 2)}"),
    (None, "'. Call '"),
    ("phone", f"'(217) 555-' || {digits(f'{K} % 10000', 4)}"),
    (None, "' now. Fax: '"),
    ("fax", f"'416-555-' || {digits(f'{K} % 10000', 4)}"),
    (None, "'. Email '"),
    ("email", f"'user' || {text(K)} || '@example.org'"),
    (None, "' today. See '"),
    ("url", f"'https://portal.example.org/p/' || {text(K)}"),
    (None, "' today. Host '"),
    ("ip", f"'10.' || {text(f'{K} % 56 + 200')} || '.' || {text(f'{K} % 7 + 40')} || '.' || {text(f'{K} % 100')}"),
    (None, "' logged. SSN '"),
    ("ssn", f"'123-45-' || {digits(f'{K} % 9999 + 1', 4)}"),
    (None, "'. Member ID: '"),
    ("health_plan", f"'XJK' || {digits(K, 6)} || 'A'"),
    (None, "'. Account number '"),
    ("account", digits(K, 10)),
    (None, "'. Card '"),
    ("credit_card", "'4111 1111 1111 1111'"),
    (None, "' on file. License number '"),
    ("license", digits(K, 7)),
    (None, "'. Serial number: '"),
    ("device", f"'PJK-' || {digits(K, 6)}"),
    (None, "'. Moved to '"),
    ("city", "'Springfield'"),
    (None, "', IL '"),
    ("zip", digits(f"{K} % 90000 + 10000", 5)),
    (None, "'. She is '"),
    ("age", text(f"90 + {K} % 10")),
    (None, "' years old. Dr. '"),
    ("name", "'Karen Whitfield'"),
    (None, "' agreed. Docket '"),
    ("docket", f"'2:25-cv-' || {digits(f'{K} % 90000 + 10000', 5)}"),
    (None, "' filed. BP 120/80, HR 72, strength 4/5, metoprolol 25 mg BID.'"),
]

JOINED = " || ".join(e for _, e in PIECES)
#: note_id, domain, mode, text.
NOTES_SQL = f"SELECT {K} AS note_id, CASE WHEN {K} % 3 = 0 THEN 'legal' ELSE 'clinical' END AS domain, CASE WHEN {K} % 4 = 0 THEN 'chat' ELSE 'written' END AS mode, {JOINED} AS text FROM customer"


def gold_sql() -> str:
    """note_id, gold_id, start, end_, label of each planted span."""
    rows, n = [], 0
    for i, (label, expr) in enumerate(PIECES):
        if label:
            before = " || ".join(e for _, e in PIECES[:i])
            rows.append(f"SELECT {K} AS note_id, {n} AS gold_id, CAST(length({before}) AS INT) AS start, CAST(length({before} || {expr}) AS INT) AS end_, '{label}' AS label FROM customer")
            n += 1
    return " UNION ALL ".join(rows)


GOLD_SQL = gold_sql()
#: What each label is in the engine's categories.
CATEGORY_OF = {"mrn": "MRN", "date": "DATE", "dob": "DATE", "phone": "PHONE", "fax": "FAX", "email": "EMAIL", "url": "URL", "ip": "IP", "ssn": "SSN", "health_plan": "PLAN", "account": "ACCOUNT", "credit_card": "ACCOUNT", "license": "LICENSE", "device": "DEVICE", "city": "LOCATION", "zip": "ZIP", "age": "AGE", "name": "NAME", "docket": "ID"}
CATEGORY_SQL = "CASE " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in CATEGORY_OF.items()) + " END"

#: Imperfect predictions: some gold spans missed, some cut short, some wide, and a false alarm in some notes.
PRED_SQL = f"""
SELECT note_id, start, CASE WHEN (note_id + gold_id) % 5 = 0 THEN end_ - 1 WHEN (note_id + gold_id) % 11 = 0 THEN end_ + 1 ELSE end_ END AS end_,
       {CATEGORY_SQL} AS category, 0.1 + 0.1 * ((note_id + gold_id) % 9) AS confidence
FROM gold WHERE (note_id * 3 + gold_id) % 13 <> 0
UNION ALL SELECT note_id, CAST(length(text) - 5 AS INT), CAST(length(text) - 1 AS INT), 'ID', 0.5 FROM notes WHERE note_id % 6 = 0"""

#: The three as common table expressions, for SQL on either engine.
WITH_NOTES = f"WITH notes AS ({NOTES_SQL}), gold AS ({GOLD_SQL}), pred AS ({PRED_SQL})"


def width(expr: str) -> int | None:
    """Length of what a piece's SQL gives for any key, if that is told by literals and padded numbers alone."""
    n = 0
    for part in expr.split(" || "):
        if part.startswith("'"):
            n += len(part) - 2
        elif padded := re.fullmatch(r"lpad\(.*, (\d+), '0'\)", part):
            n += int(padded[1])
        else:
            return None
    return n


def places() -> tuple[list[Column], list[Column]]:
    """Lengths of the pieces that vary, as columns, and where each piece starts (and the last one ends) by these columns.

    The first piece that is no literal counts among those that vary, so that a null key gives no places after it.
    """
    varying, at, fixed, seen = [], [F.lit(0)], 0, F.lit(0)
    for label, expr in PIECES:
        n = width(expr)
        if n is None or (label and not varying):
            varying.append(F.length(F.expr(expr)).alias(f"n{len(varying)}"))
            seen = seen + F.col(f"n{len(varying) - 1}")
        else:
            fixed += n
        at.append((seen + fixed).cast("int"))
    return varying, at


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, gold, predictions) with doc_id, start and end: the same rows as the SQL above, each from one scan, dealt by document."""
    k = dealt_by(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    k3, k4 = F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 == 0
    pieces = k.select(F.col("c_custkey").alias("doc_id"), F.array(*[F.expr(e) for _, e in PIECES]).alias("p"))
    docs = pieces.select("doc_id", F.when(k3, "legal").otherwise("clinical").alias("domain"), F.when(k4, "chat").otherwise("written").alias("mode"), F.array_join("p", "").alias("text"))
    varying, at = places()
    pieces = k.select(F.col("c_custkey").alias("doc_id"), *varying)
    spans = F.array(*[F.struct(at[i].alias("start"), at[i + 1].alias("end"), F.lit(label).alias("label")) for i, (label, _) in enumerate(PIECES) if label])
    gold = pieces.select("doc_id", F.posexplode(spans).alias("gold_id", "g")).select("doc_id", "gold_id", "g.start", "g.end", "g.label")
    i = F.col("doc_id") + F.col("gold_id")
    moved = F.when(i % 5 == 0, F.col("end") - 1).when(i % 11 == 0, F.col("end") + 1).otherwise(F.col("end"))
    hits = gold.where("(doc_id * 3 + gold_id) % 13 <> 0").select("doc_id", "start", moved.alias("end"), F.expr(CATEGORY_SQL).alias("category"), (0.1 + 0.1 * (i % 9)).alias("confidence"))
    false = docs.where("doc_id % 6 = 0").select("doc_id", (F.length("text") - 5).alias("start"), (F.length("text") - 1).alias("end"), F.lit("ID").alias("category"), F.lit(0.5).alias("confidence"))
    return docs, gold, hits.unionByName(false)
