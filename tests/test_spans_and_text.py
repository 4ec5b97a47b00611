"""Interval algebra, rewriting, reading, synthesis, sequences, pages and streams."""

from __future__ import annotations

import json
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import dates
from maskwright.operators import evaluate, intervals, ocr, render, stats, synth, windows
from maskwright.sources import readers
from maskwright.streaming import vaults

SPAN = st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("AB"), st.sampled_from(["rule", "model", "propagated"]), st.sampled_from([0.2, 0.5, 0.9]))


@given(st.lists(SPAN, max_size=12))
@settings(max_examples=200, deadline=None)
def test_merge_is_disjoint_sorted_and_covers(raw):
    spans = [(a, a + n, c, s, p, False) for a, n, c, s, p in raw]
    out = intervals.fold_merge(spans)
    assert all(x[1] <= y[0] for x, y in zip(out, out[1:]))
    assert {i for a, b, *_ in spans for i in range(a, b)} == {i for a, b, *_ in out for i in range(a, b)}
    assert all(not (x[0] < y[1] and y[0] < x[1]) for x in intervals.fold_subtract(spans, out[:1]) for y in out[:1])


def test_merge_window_is_the_fold(spark):
    r = np.random.default_rng(0)
    rows = []
    for doc in range(60):
        for seq in range(int(r.integers(0, 9))):
            a = int(r.integers(0, 30))
            rows.append((doc, seq, a, a + int(r.integers(1, 9)), "ABC"[r.integers(3)], ["rule", "model"][r.integers(2)], float([0.3, 0.6, 0.9][r.integers(3)])))
    df = spark.createDataFrame(rows, "doc_id int, seq int, start int, end int, category string, source string, confidence double")
    got = sorted((x.doc_id, x.start, x.end, x.category) for x in intervals.merge(df, score=intervals.rank(F.col("source"), F.col("confidence")), carry=["category"]).collect())
    want = sorted((d, *s[:3]) for d in range(60) for s in intervals.fold_merge([(a, b, c, s, p, False) for dd, _, a, b, c, s, p in rows if dd == d]))
    assert got == want


def test_greedy(spark):
    rows = [(1, 0, 0, 5, 0.4), (1, 1, 3, 9, 0.9), (1, 2, 9, 12, 0.1), (1, 3, 0, 2, 0.2)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, start int, end int, score double")
    assert sorted(x.seq for x in intervals.resolve_by_score(df).collect()) == [1, 2, 3]
    assert sorted(x.seq for x in intervals.resolve_longest(df).collect()) == [1, 2, 3]


DATES = [("2020-03-01T10:00", "2020-02-20T10:00"), ("03/04/2021", "02/22/2021"), ("3/4/2021", "2/22/2021"), ("25/12/2020", "15/12/2020"), ("15/01/2021", None), ("March 1st, 2020", "February 20th, 2020"), ("Sept. 12, 2020", "Sep. 2, 2020"), ("2021-02-30", None), ("soon", None), ("MAY 5, 2021", "APR 25, 2021")]


def test_date_shift(spark):
    assert [render.moved(x, -10) for x, _ in DATES] == [y for _, y in DATES]
    rows = spark.createDataFrame(DATES, "x string, want string").withColumn("got", dates.shift_date(F.col("x"), F.lit(-10)))
    assert all(r.got == r.want for r in rows.collect())


def test_vault_tags_and_persons():
    v = render.Vault("k", now=2025)
    assert v.tag("NAME", "Karen Whitfield") == "[NAME_1]" and v.tag("NAME", "Dr. Whitfield") == "[NAME_1.2]" and v.tag("NAME", "Ilse") == "[NAME_2]"
    assert v.tag("DATE", "03/14/2024") == "[DATE_1:2024]" and v.tag("DATE", "01/02/1930", True) == "[DATE_2]" and v.tag("DATE", "March 4") == "[DATE_3]"
    assert v.tag("ZIP", "62704") == "[ZIP_1:627]" and v.tag("ZIP", "03601") == "[ZIP_2:000]" and v.tag("ZIP", "K1A 0B1") == "[ZIP_3]" and v.tag("AGE", "93") == "[AGE_1:90+]"
    assert v.tag("PHONE", "(217) 555-0142") == v.tag("PHONE", "217-555-0142")
    assert v.restore("to [name_1] and [ NAME 1.2 ] on [DATE_1:2024], [NAME_9]") == ("to Karen Whitfield and Dr. Whitfield on 03/14/2024, [NAME_9]", 3)


TEXT = "Dr. Karen Whitfield saw WHITFIELD, KAREN on 03/14/2024. Call (217) 555-0142. SSN 123-45-6789. Mail a@example.org. MRN 00AB1234. Springfield, IL 62704."


@pytest.mark.parametrize("mode", ["tag", "surrogate"])
def test_render_and_restore(mode):
    from maskwright.operators.detect import detect_text

    spans, _ = detect_text(TEXT)
    v = render.Vault("s", mode)
    out, items = v.render(TEXT, ((s[0], s[1], s[2], s[5]) for s in spans))
    assert all(out[i[4] : i[5]] == i[3] for i in items)
    assert not any(TEXT[a:b] in out for a, b, *_ in spans if b - a > 4)
    assert v.restore(out)[0] == TEXT
    if mode == "surrogate":
        assert "555-01" in out and re.search(r"\b000-00-\d{4}", out) and "627" in out


def test_splice(spark):
    df = spark.createDataFrame([("a😀bcd", [(1, 2, "X"), (1, 3, "no"), (3, 4, "YY")])], "text string, items array<struct<start: int, end: int, replacement: string>>")
    assert df.select(render.splice(F.col("text"), F.col("items"))).collect()[0][0] == "aXbYYd"


def test_jsonl(spark, tmp_path):
    lines = [{"id": "a", "text": "Ann 😀 Bo", "spans": [{"start": 0, "end": 3, "label": "NAME", "tags": ["cue"]}, {"start": 5, "end": 5, "label": "x"}, {"start": "q", "end": 9}]}, {"id": 7, "full_text": "hi", "entities": json.dumps([{"start": 0, "end": 99, "entity_type": "ORG"}])}, {"document": "x", "spans": 3}]
    p = tmp_path / "d.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\n\n" + json.dumps(lines[2]) + "\n")
    rows = {r.doc_id: r for r in readers.read_documents(spark, str(p)).collect()}
    assert set(rows) == {"a", "doc2", "doc4"}
    assert [(g.start, g.end, g.label, g.tags) for g in rows["a"].gold] == [(0, 3, "NAME", ["cue"])]
    assert [(g.start, g.end, g.label) for g in rows["doc2"].gold] == [(0, 2, "ORG")] and rows["doc4"].gold == []
    assert readers.read_documents(spark, str(p), 1).count() == 1
    p.write_text('{"id": "a"}\n')
    with pytest.raises(Exception, match="no text field"):
        readers.read_documents(spark, str(p)).collect()
    p.write_text('{"id": "a", "text": "x"}\n{"id": "a", "text": "y"}\n')
    with pytest.raises(Exception, match="duplicate id"):
        readers.read_predictions(spark, str(p)).collect()


def test_markup_and_tables(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("Seen {{name|Ann\nLee}} and {{mrn|12}}.\n---\nplain text\n---\n")
    rows = readers.read_markup(spark, str(p)).orderBy("doc").collect()
    assert [r.text for r in rows] == ["Seen Ann\nLee and 12.", "plain text"]
    assert [(s.start, s.end, s.label) for s in rows[0].spans] == [(5, 12, "name"), (17, 19, "mrn")] and rows[1].spans == []
    replies = spark.createDataFrame([("<think>x</think>Hi {{NAME|Bo}}",), ("no marks",), ("{{ODD|x}}",), ("<think>open {{NAME|Bo}}",), ("a {{NAME|Bo}} }}",)], "raw string")
    assert [r.text for r in readers.parse_reply_markup(replies, ["NAME"]).collect()] == ["Hi Bo"]
    c = tmp_path / "r.csv"
    c.write_text("item,a,b\nd#1,2,\nd#2,0,1\n")
    assert sorted((r.item, r.system, r.outcome) for r in readers.read_responses(spark, str(c)).collect() if r.outcome is not None) == [("d#1", "a", 2), ("d#2", "a", 0), ("d#2", "b", 1)]
    t = tmp_path / "t.md"
    t.write_text("| system | recall |\n|---|---|\n| ours | 99.1 | 98.0 | 0.5 % | 0.2 % | 99.0 |\n")
    assert [(r.system, r.leak) for r in readers.read_results_table(spark, str(t)).collect()] == [("ours", 0.5)]


def test_formats_and_substitution(spark):
    for f in ("{L2}-{d6}", "{fn} {ln}", "{Month} {do}, {yyyy}", "A.{x4}({h2})"):
        assert all(re.match(synth.format_regex(f), synth.sample_format(f, str(i))) for i in range(50))
    assert synth.infer_format("AB-12x") == "{L2}-{d2}{l1}"
    assert set(synth.novel({"t": "{d4}"}, ["{d4}"])) == {"t"} and not synth.novel({"t": "{L4}"}, ["{d4}"])
    rows = spark.createDataFrame([(1, "A [[X_1]], [[X_1]] b", [("X_1", "val", "name", 2)]), (2, "[[Q]] [[", [("X_1", "v", "name", 1)])], "doc_id int, text string, planted array<struct<ph: string, value: string, label: string, count: int>>")
    a, b = synth.substitute(rows).orderBy("doc_id").collect()
    assert a.text == "A val, val b" and [(s.start, s.end) for s in a.spans] == [(2, 5), (7, 10)] and not a.problems
    assert sorted(b.problems) == ["brackets", "missing X_1", "unknown Q"]
    assert synth.verbatim("Ann Lee and Ann", [("Ann", "n"), ("Ann Lee", "n")]) == [(0, 7, "n"), (12, 15, "n")]
    reasons = {r for r, *_ in synth.screen_text("Call 217-555-0142 at 10:30, took 5000 mg, BP 90/60", [])}
    assert "phone" in reasons and "time" in reasons and synth.screen_text("", []) == [("empty-text", "", 0)]
    assert not [x for x in synth.screen_text("took 5000 mg", []) if x[0] == "digits"]
    with pytest.raises(ValueError):
        synth.refuse_paths(["/x/dev_set.jsonl"])


def test_viterbi_and_windows(spark):
    tags = ["O", "B-X", "I-X", "E-X", "S-X"]
    r = np.random.default_rng(3)
    for _ in range(30):
        s = r.normal(size=(4, 5))
        best = max(((sum(s[i, t] for i, t in enumerate(p)), p) for p in np.ndindex(5, 5, 5, 5) if all(windows.allowed(tags[a], tags[b]) for a, b in zip(p, p[1:])) and windows.allowed("", tags[p[0]]) and windows.allowed(tags[p[-1]], "")))
        assert windows.viterbi(s, tags) == [tags[t] for t in best[1]]
    w = windows.token_windows(spark.createDataFrame([(1, 50), (2, 10), (3, 0)], "doc_id int, n int"), 24).collect()
    assert {x.tok for x in w if x.doc_id == 1} == set(range(50)) and max(x.win for x in w if x.doc_id == 1) == 2
    assert all(x.weight == 1 for x in w if x.doc_id == 2)
    assert windows.chunk_words([3, 3, 3, 3], 7, 1) == [(0, 2), (1, 3), (2, 4)]


def test_statistics(spark):
    rows = [(f"d{i}#0", s, o) for i in range(12) for s, o in (("a", 0 if i < 5 else 2), ("b", 0 if i < 1 else 2))]
    m = stats.mcnemar(stats.leak_vector(spark.createDataFrame(rows, "item string, system string, outcome int")), "a", "b").collect()[0]
    assert (m.only_a, m.only_b) == (4, 0) and abs(m.p - 0.125) < 1e-12
    a, b, theta, se = stats.fit_2pl(np.array([[1.0, 0, 0], [1, 1, 0], [0, 1, 1]]), np.array([10.0, 10, 3]))
    assert theta[0] > theta[2] and (a > 0).all() and (se > 0).all()
    empty = stats.mcnemar(stats.leak_vector(spark.createDataFrame([], "item string, system string, outcome int")), "a", "b").collect()[0]
    assert empty.p == 1.0


def test_evaluation_counts_bytes(spark):
    docs = spark.createDataFrame([(1, "é Ann Lee 95 x", "c", "w")], "doc_id int, text string, domain string, mode string")
    gold = spark.createDataFrame([(1, 0, 2, 9, "name", ["t"]), (1, 1, 10, 12, "age", []), (1, 2, 0, 1, "weather", [])], "doc_id int, gold_id int, start int, end int, label string, tags array<string>")
    pred = spark.createDataFrame([(1, 2, 5, "NAME", 0.9), (1, 13, 14, "ID", 0.9)], "doc_id int, start int, end int, category string, confidence double")
    s = {r.gold_id: r for r in evaluate.outcomes(gold, pred, docs).collect()}
    assert set(s) == {0, 1} and (s[0].outcome, s[0].covered, s[0].body) == (1, 3, 6) and s[1].outcome == 0
    assert [r.doc_id for r in evaluate.leaking(evaluate.outcomes(gold, pred, docs)).collect()] == [1]
    over = evaluate.over_redaction(gold, pred, docs).collect()[0]
    assert (over.clean_chars, over.clean_redacted) == (1, 1)


def test_page_words(spark):
    page = {"pages": [{"width": 100, "height": 50, "lines": [{"text": "Ann Lee", "box": [0, 0, 70, 10], "words": [{"text": "Ann", "start": 0, "end": 3, "box": [0, 0, 30, 10]}, {"text": "Lee", "start": 9, "end": 12, "box": [40, 0, 0, 0]}]}]}]}
    pages = ocr.parse(spark.createDataFrame([(1, json.dumps(page))], "doc_id int, json string"))
    spans = spark.createDataFrame([(1, 0, 0, 0, 7, "NAME")], "doc_id int, page int, seq int, start int, end int, category string")
    b = {r.word: r for r in ocr.boxes(ocr.words(pages), spans).collect()}
    assert (b[0].x, b[0].w) == (0.0, 32.0) and (b[1].x, b[1].w) == (38.0, 34.0)
    assert ocr.page_texts(pages).collect()[0].text == "Ann Lee"


def test_stream_keeps_a_vault_for_each_session(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("s1", 0, "Dr. Karen Whitfield came"), ("s1", 1, "Dr. Whitfield left"), ("s2", 0, "MRN: 00123456"), ("s2", 1, None)]
    spark.createDataFrame(rows, "session_id string, ord long, text string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("session_id string, ord long, text string").parquet(str(src))
    q = vaults.redact_stream(stream).writeStream.format("memory").queryName("redacted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.monotonic() + 100
    while spark.table("redacted").count() < len(rows) and time.monotonic() < end:  # the query itself goes on, as idle sessions have to time out
        time.sleep(0.2)
    q.stop()
    got = {(r.session_id, r.ord): r.text for r in spark.sql("SELECT * FROM redacted").collect()}
    assert got == {("s1", 0): "Dr. [NAME_1] came", ("s1", 1): "Dr. [NAME_1.2] left", ("s2", 0): "MRN: [MRN_1]", ("s2", 1): ""}
    state = vaults.dumped(render.Vault("k", counters={"NAME": 2}, seen={("NAME", "x"): "[NAME_1]"}))
    assert vaults.loaded("k", "tag", 2025, state).seen == {("NAME", "x"): "[NAME_1]"}
