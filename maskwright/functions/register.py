"""SQL functions of the engine: register(spark) makes them callable from Spark SQL."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import validators
from .categories import SPANS
from .labels import label_sql, map_label

CHECKS = {"valid_luhn": validators.luhn, "valid_ssn": validators.valid_ssn, "valid_vin": validators.valid_vin, "valid_aba": validators.valid_aba, "valid_iban": validators.valid_iban}


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("dob", T.BooleanType())])


@F.udtf(returnType=SPAN)
class DetectSpans:
    """Spans of a text, one row each, for single texts: it goes to Python row by row, deid_spans(text) in batches."""

    def eval(self, text: str):
        from ..operators.detect import detect_text

        yield from detect_text(text)[0]


def check_udf(f):
    @F.pandas_udf(T.BooleanType())
    def check(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else f(x))

    return check


@F.arrow_udf(T.StructType([T.StructField("tagged", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]))
def scanned_text(v: pa.Array) -> pa.Array:
    """A text with tags and its spans, of one detection."""
    from ..operators.detect import FIELDS, as_rows, detect_text
    from ..operators.render import Vault

    texts = [t or "" for t in v.to_pylist()]
    found = [detect_text(t)[0] for t in texts]
    tagged = [Vault("").render(t, ((s[0], s[1], s[2], s[5]) for s in spans))[0] for t, spans in zip(texts, found, strict=True)]
    spans = pa.array([as_rows(spans) for spans in found], pa.list_(pa.struct(FIELDS)))
    return pa.StructArray.from_arrays([pa.array(tagged, pa.string()), spans], names=["tagged", "spans"])


@F.pandas_udf(T.StringType())
def shift_date(v: pd.Series, days: pd.Series) -> pd.Series:
    from ..operators.render import moved

    return pd.Series([None if a is None else moved(a, int(b)) for a, b in zip(v, days, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def year_of(v: pd.Series, now: pd.Series) -> pd.Series:
    from ..operators.render import year_in

    return pd.Series([None if a is None else year_in(a, int(n)) for a, n in zip(v, now, strict=True)], dtype="Int32")


def register(spark: SparkSession) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION map_label(label STRING) RETURNS STRING RETURN {label_sql('label', 'rlike')}")
    spark.udtf.register("deid_detect", DetectSpans)
    spark.udf.register("deid_scan", scanned_text)
    for name, kind, part in (("deid_tag", "STRING", "tagged"), ("deid_spans", SPANS, "spans")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN deid_scan(text).{part}")
    spark.udf.register("shift_date", shift_date)
    spark.udf.register("year_of", year_of)
    for name, f in CHECKS.items():
        spark.udf.register(name, check_udf(f))


#: Labels of a vocabulary up to which they are sent to every task.
MOST_LABELS = 1_000


def with_mapped_labels(df: DataFrame, column: str = "label", to: str = "category") -> DataFrame:
    """df with the category of a label column: mapped over its distinct values, which are counted first and sent to every
    task where they are few; a larger vocabulary is mapped row by row."""
    few = df.select(column).distinct().limit(MOST_LABELS + 1).select(F.col(column).alias("__raw"), map_label(F.col(column)).alias(to)).collect()
    if len(few) > MOST_LABELS:
        return df.withColumn(to, map_label(F.col(column)))
    known = df.sparkSession.createDataFrame([tuple(r) for r in few], f"__raw string, `{to}` string")
    return df.join(F.broadcast(known), F.col(column).eqNullSafe(F.col("__raw")), "left").drop("__raw")
