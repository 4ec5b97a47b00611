"""Writers, SQL functions, page redaction, verification and merging of responses."""

from __future__ import annotations

import json

import pytest

from maskwright.functions import register
from maskwright.operators import evaluate, ocr, stats, synth
from maskwright.sources import sinks


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT deid_tag('MRN: 00123456') AS t, valid_vin('1HGCM82633A004352') AS v, shift_date('03/04/2021', -10) AS d, year_of('03/04/2021', 2025) AS y").collect()[0].asDict() == {"t": "MRN: [MRN_1]", "v": True, "d": "02/22/2021", "y": 2021}
    assert [(r.start, r.category) for r in spark.sql("SELECT * FROM deid_detect('MRN: 00123456')").collect()] == [(5, "MRN")]
    rows = spark.createDataFrame([("B-NAME",), (None,), ("email",)], "label string")
    assert sorted((r.label or "", r.category) for r in register.with_mapped_labels(rows).collect()) == [("", "KEEP"), ("B-NAME", "NAME"), ("email", "EMAIL")]


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Ann 7", [(0, 3, "name", []), (4, 5, "nothing", [])])], "doc_id string, text string, gold array<struct<start: int, end: int, label: string, tags: array<string>>>")
    counts = sinks.write_converted(docs, str(tmp_path / "c")).collect()[0]
    assert (counts.kept, counts.dropped) == (1, 1)
    assert json.loads(spark.read.text(str(tmp_path / "c")).collect()[0][0]) == {"id": "a", "text": "Ann 7", "spans": [{"start": 0, "end": 3, "label": "NAME"}]}
    t = spark.createDataFrame([("x", 0.5, None), ("y", float("nan"), 2)], "name string, recall double, n int")
    assert sinks.markdown(t, ["name"]).splitlines()[2:] == ["| x | 0.5 | – |", "| y | – | 2 |"]
    s = spark.createDataFrame([(0.5, float("nan"))], "threshold double, recall double")
    assert json.loads(sinks.sweep_json(s)) == [{"threshold": 0.5, "recall": None}]
    assert sinks.manifest({"d": docs}, "doc_id", 1, {"d": 1.0}).collect()[0].rows == 1


def test_redacted_pages(spark):
    page = {"pages": [{"width": 300, "height": 50, "lines": [{"text": "MRN: 00123456", "words": [{"text": "MRN:", "start": 0, "end": 4, "box": [0, 0, 40, 10]}, {"text": "00123456", "start": 5, "end": 13, "box": [50, 0, 80, 10]}]}]}]}
    boxes, spans = ocr.redact_pages(ocr.parse(spark.createDataFrame([(1, json.dumps(page))], "doc_id int, json string")))
    assert [(r.word, r.x, r.w) for r in boxes.collect()] == [(1, 48.0, 84.0)]
    assert json.loads(sinks.boxes_json(boxes).collect()[0].json) == {"boxes": [{"page": 0, "box": [48.0, 0.0, 84.0, 12.0]}]}
    assert [(r.category, r.spans, r.boxes) for r in ocr.report(boxes, spans).collect()] == [("MRN", 1, 1)]


def test_verification(spark):
    specs = spark.createDataFrame([(1, [("N", "Ann", "name", 1)]), (2, [("N", "Bo", "name", 1)]), (3, [("N", "Cy", "name", 1)])], "doc_id int, planted array<struct<ph: string, value: string, label: string, count: int>>")
    raws = spark.createDataFrame([(1, 0, "bad", "length"), (1, 1, "Met [[N]] now", "stop"), (2, 0, "Call 217-555-0142 [[N]]", "stop")], "doc_id int, seq int, text string, finish_reason string")
    got = {r.doc_id: r for r in synth.verified(specs, raws).collect()}
    assert not got[1].problems and got[1].text == "Met Ann now" and [(s.start, s.end) for s in got[1].spans] == [(4, 7)]
    assert "phone" in got[2].problems and "no-raw-output" in got[3].problems
    assert [r.doc_id for r in synth.unfinished(specs, raws).collect()] == [3]


def test_merged_responses(spark):
    a = spark.createDataFrame([("d#0", 1, 2), ("d#1", 0, 0)], "item string, x int, y int")
    b = spark.createDataFrame([("d#0", 2, 1), ("d#1", 0, 2)], "item string, y int, z int")
    assert sorted(tuple(r) for r in stats.merged_responses(a, b).collect()) == [("d#0", 1, 2, 1), ("d#1", 0, 0, 2)]
    with pytest.raises(Exception, match="differs"):
        stats.merged_responses(a, b.selectExpr("item", "y + 1 AS y")).collect()
    with pytest.raises(Exception, match="item sets differ"):
        stats.merged_responses(a, b.limit(1)).collect()


def test_review(spark):
    from maskwright.operators import intervals

    spans = spark.createDataFrame([(1, 0, 4, "NAME", "rule", 0.9), (1, 10, 14, "ID", "rule", 0.9), (1, 20, 25, "DATE", "model", 0.6)], "doc_id int, start int, end int, category string, source string, confidence double")
    manual = spark.createDataFrame([(1, 3, 8, "ORG")], "doc_id int, start int, end int, category string")
    off = spark.createDataFrame([(1, 10, 14)], "doc_id int, start int, end int")
    assert sorted((r.start, r.end, r.category) for r in intervals.reviewed(spans, manual, off).collect()) == [(0, 8, "ORG"), (20, 25, "DATE")]


def test_generators(spark):
    notes = synth.carrier_notes(spark, 40, 1, [("mrn", "{d8}"), ("name", "{fn} {ln}")], 2).collect()
    assert len(notes) == 40 and all(0 <= s.start < s.end <= len(n.text) and n.text[s.start : s.end].strip() for n in notes for s in n.spans)
    again = {r.doc_id: r.text for r in synth.carrier_notes(spark, 40, 1, [("mrn", "{d8}"), ("name", "{fn} {ln}")], 5).collect()}
    assert again == {r.doc_id: r.text for r in notes}
    new = synth.revalued([{"label": "mrn", "value": "1", "tags": ["spoken", "cue"]}, {"label": "x", "value": "2"}], {"mrn": [("f", "{L3}{d3}")]}, 1, "d")
    assert new[0]["tags"] == ["cue", "novel_format", "fmt:f"] and new[1]["value"] == "2" and new[0]["value"] != "1"


def test_sweeps_hold_every_threshold(spark):
    n = 1_200
    gold = spark.createDataFrame([("d", 0, 0, 3, "name", [])], "doc_id string, gold_id int, start int, end int, label string, tags array<string>")
    hits = spark.createDataFrame([("d", 0, 3, "NAME", 0.5)], "doc_id string, start int, end int, category string, confidence double")
    docs = spark.createDataFrame([("d", "Ann 7")], "doc_id string, text string")
    swept = evaluate.sweep(gold, hits, docs, spark.range(n).selectExpr("id / 1200 AS threshold")).select("threshold", "gold", "caught").cache()
    assert [(r.threshold, r.gold, r.caught) for r in swept.orderBy("threshold").collect()] == [(i / n, 1, int(i / n <= 0.5)) for i in range(n)]
    assert len(json.loads(sinks.sweep_json(swept))) == n and len(sinks.markdown(swept, ["threshold"]).splitlines()) == n + 2
