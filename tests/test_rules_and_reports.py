"""Names in capitals, word starts, stand-ins, generators, screens and reports."""

from __future__ import annotations

import io
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators import detect, evaluate, formats, generators, names, render, stats, synth, windows
from maskwright.operators.rules import RULES
from maskwright.operators.starts import Index, prefixes
from maskwright.plans import rule_notes
from maskwright.sources import readers, sinks


def names_in(text):
    return [text[a:b] for a, b, category, *_ in detect.rule_spans(text) if category == "NAME"]


@pytest.mark.parametrize(("text", "name"), [("BRANDT, SILVIA has read it.", "BRANDT, SILVIA"), ("From: CORTEZ, DAMIAN To: Front Desk", "CORTEZ, DAMIAN"), ("Signed by O'HARA, SAM today.", "O'HARA, SAM"), ("Sent on to VAN DEN HEUVEL, LOTTE.", "VAN DEN HEUVEL, LOTTE"), ("Attn: Brandt, Silvia", "Brandt, Silvia"), ("cc: van der Meer, Ilse", "van der Meer, Ilse"), ("Contact Brandt, Silvia DOB 03/14/1958", "Brandt, Silvia")])
def test_surname_first(text, name):
    assert name in names_in(text)


@pytest.mark.parametrize("text", ["She moved to Brandt, Silvia last year.", "Riverton, Utah is home.", "HISTORY, SOCIAL as before.", "COUGH, FEVER, AND CHILLS denied.", "IBUPROFEN, ATORVASTATIN daily.", "WHEREAS, THEREFORE, they agree.", "PUT, DELETE requests failed.", "PDF, XLSX files attached.", "BOSTON, CANADA office.", "HOLDINGS, LLC was called.", "STAGE III, IV disease."])
def test_pairs_that_are_no_names(text):
    assert not names_in(text)


def test_stop_words_of_a_run(tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("Quuxify\nblorp zanth\n")
    stop = names.load_stop_words(str(path))
    assert stop == {"quuxify", "blorp", "zanth"}
    text = "QUUXIFY, BLORP noted."
    assert [s[2] for s in detect.detect_text(text)[0]] == ["NAME"]
    assert not detect.detect_text(text, detect.Config(stop_words=stop))[0]
    assert [s[2] for s in detect.detect_text(text)[0]] == ["NAME"]


pieces = st.sampled_from([x for _, before, _, after in rule_notes.CASES.values() for x in (before, after)] + ["00482913", "03/14/2024", "(217) 555-2368", "4111 1111 1111 1111", "MUELLER, GLORIA", "Karen Whitfield", "IL 62704", "é", "İ", "\n", "_", "-", "1HGCM82633A004352", "a@b.org"])


@given(st.lists(pieces, max_size=8).map("".join), st.booleans())
@settings(max_examples=200, deadline=None)
def test_word_starts_lose_no_match(text, upper):
    text = text.upper() if upper else text
    if len(text.lower()) == len(text):
        index = Index(text, text.lower())
        for rule in RULES:
            assert list(detect.scan(rule, text, index)) == list(detect.scan(rule, text)), rule.name


def test_prefixes():
    assert prefixes(r"(?i)\b(?:fax|tel\.?)\s*\d") == {"fax", "tel"} and prefixes(r"\b\d{2}-x") == {"00-"}
    assert prefixes(r"fax") is None and prefixes(r"\b.x") is None


def test_words_of_stand_ins_are_turned_back():
    v = render.Vault("k", "surrogate")
    text = "Patient: Maria Gonzalez, zip 62704, code 12"
    out, _ = v.render(text, iter([(9, 23, "NAME", False), (29, 34, "ZIP", False), (41, 43, "ZIP", False)]))
    given_, family = re.search(r"Patient: (\S+) (\S+),", out).groups()
    assert v.restore(f"{family} and {given_}, {family.upper()}")[0] == "Gonzalez and Maria, GONZALEZ"
    assert re.search(r"zip 627\d\d, code \[ZIP_1", out)  # two digits are no ZIP
    assert v.restore(out)[0] == text


def test_vaults_stream_through_a_task(spark):
    spans = "array<struct<start: int, end: int, category: string, dob: boolean>>"
    rows = spark.createDataFrame([(k, i, f"MRN 0000{i % 3}", [(4, 9, "MRN", False)]) for k in ("a", "b") for i in range(40)], f"vault string, ord long, text string, spans {spans}")
    made = render.render_vaults(rows)
    back = {(r.vault, r.ord): (r.text, r.shown, r["count"]) for r in render.restored(made).collect()}
    assert back == {(k, i): (f"MRN 0000{i % 3}", f"MRN [MRN_{i % 3 + 1}]", 1) for k in ("a", "b") for i in range(40)}


def test_formats_are_one_function_everywhere(spark):
    import duckdb

    for pattern in ("{L2}-{d4}", "{Mon} {do}, {yyyy}", "{fn} {ln}", "it''s {n}{c}{a}".replace("''", "'")):
        want = [formats.sample_format(pattern, str(i)) for i in range(20)]
        assert all(re.match(formats.format_regex(pattern), v) for v in want)
        rows = spark.range(20).select("id", formats.format_column(pattern, F.col("id").cast("string")).alias("v")).orderBy("id").collect()
        assert [r.v for r in rows] == want
        assert [r[0] for r in duckdb.sql(f"SELECT {formats.format_sql(pattern, 'CAST(i AS VARCHAR)', False)} FROM range(20) t(i)").fetchall()] == want


def test_specs_depend_on_seed_and_id_alone(spark):
    by = lambda df: {(r.doc_id, r.slot): r.value for r in df.collect()}
    all_, some = by(generators.plant_specs(generators.document_ids(spark, 60, 3), 1)), by(generators.plant_specs(generators.document_ids(spark, 60, 1).where("doc_id > 50"), 1))
    assert {k: v for k, v in all_.items() if k[0] > 50} == some and by(generators.plant_specs(generators.document_ids(spark, 60), 2)) != all_
    sizes: dict[int, int] = {}
    for d, _ in all_:
        sizes[d] = sizes.get(d, 0) + 1
    assert len(sizes) == 60 and min(sizes.values()) >= 3 and max(sizes.values()) <= 12
    notes = generators.template_notes(generators.document_ids(spark, 40), "legal", "B", 3).collect()
    for n in notes:
        for s in n.spans:
            assert n.text[s.start : s.end].strip() == n.text[s.start : s.end] != ""


def test_screens_know_titles_and_phrases():
    pools = synth.Pools(frozenset({"harrow"}), frozenset({"mark", "elena"}), frozenset({"mark"}), ("Penny Lane",))
    found = lambda t: {r for r, *_ in synth.screen_text(t, [], pools) if r != "engine"}
    assert found("We saw Dr. Harrow there") == {"name-pool"} and found("Mark the day. Mark it.") == set()
    assert found("we met Mark") == {"common-name"} and found("Elena left") == {"common-name"} and found("on Penny Lane now") == {"pool-phrase"}
    item = [{"ph": "NAME_1", "value": "Quist"}]
    assert synth.echoes("[[NAME_1]]\n[[NAME_1]] = x\n[[NAME_1]]", item, "", []) == ["echoed-value-list"]
    assert synth.echoes("fine", item, "Quist came, Quist left", [(0, 5)]) == ["value-echo:NAME_1"]


def test_long_tails_and_quantiles(spark):
    from statistics import NormalDist

    x = spark.createDataFrame([(p / 200,) for p in range(0, 201)], "p double").select("p", F.expr(stats.probit_sql("p")).alias("z")).collect()
    assert all((r.z is None) if r.p in (0, 1) else abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 for r in x)
    rows = spark.range(6000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc"), F.explode(F.array(F.struct(F.lit("a").alias("system"), (F.col("id") < 2900).alias("leaked")), F.struct(F.lit("b").alias("system"), (F.col("id") >= 2900).alias("leaked")))).alias("s")).select("doc", "s.*")
    m = stats.mcnemar(rows, "a", "b").collect()[0]
    import math

    exact = 2 * sum(math.comb(6000, i) for i in range(2901)) / 2**6000
    assert (m.only_a, m.only_b) == (2900, 3100) and abs(m.p - exact) < 1e-9


def test_many_labels_are_mapped_row_by_row(spark, monkeypatch):
    from maskwright.functions import register

    rows = spark.createDataFrame([("B-NAME",), (None,), ("mrn",), ("mrn",)], "label string")
    few = sorted(map(str, register.with_mapped_labels(rows).collect()))
    monkeypatch.setattr(register, "MOST_LABELS", 1)
    assert sorted(map(str, register.with_mapped_labels(rows).collect())) == few and len(few) == 4


def test_chunks_are_pieces_of_the_text(spark):
    text = "One, two-three  four.\nFive six (seven) eight nine ten"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    out = windows.text_chunks(rows, 6).orderBy("doc_id", "win").collect()
    assert all(text[r.start : r.start + len(r.chunk)] == r.chunk for r in out if r.doc_id == 1) and {r.doc_id for r in out} == {1, 4}
    assert out[0].chunk == "One, two-three  four.\nFive" and text.endswith(out[-2].chunk)
    with pytest.raises(Exception, match="longer than a window"):
        windows.word_windows(spark.createDataFrame([(1, [9])], "doc_id long, sizes array<int>"), 5, 1).collect()


def test_guards(spark):
    rows = spark.createDataFrame([(1, "train"), (2, None)], "id int, split string")
    assert synth.trainable(rows).count() == 2
    with pytest.raises(Exception, match="must not be trained on: dev"):
        synth.trainable(rows.union(spark.createDataFrame([(3, "dev")], rows.schema))).collect()
    with pytest.raises(ValueError, match="sealed"):
        synth.refuse_sealed(["/data/sealed-2/notes.jsonl"])


def test_reports(spark):
    counts = spark.createDataFrame([("NAME", 4, 3, 2, 40, 30, 5, 4), ("MRN", 0, 0, 0, 0, 0, 1, 0)], "category string, gold long, caught long, full long, gold_chars long, covered_chars long, predicted long, predicted_correct long")
    lines = sinks.report_lines(counts)
    assert len(lines) == 4 and lines[1].startswith("MRN") and "–" in lines[1] and lines[3].split() == ["ALL", "4", "3", "2", "6", "75.0%", "50.0%", "75.0%", "66.7%"]
    assert json.loads(sinks.report_json(counts))["overall"]["recall"] == 0.75
    assert evaluate.overall(counts).collect()[0].gold == 4
    assert readers.read_note(spark, io.StringIO("all of it\n")).collect()[0].text == "all of it\n"


def test_item_fit_is_a_maximum():
    import numpy as np

    patterns = np.array([[1.0, 0, 0, 1], [1, 1, 0, np.nan], [0, 1, 1, 0], [1, 1, 1, 0]])
    counts = np.array([10.0, 7, 3, 5])
    a, b, theta, _ = stats.fit_2pl(patterns, counts, rounds=2_000, tol=1e-10)

    def goal(la, b, theta):
        p = 1 / (1 + np.exp(-np.exp(la)[:, None] * (theta[None, :] - b[:, None])))
        fit = np.where(np.isnan(patterns), 0, np.nan_to_num(patterns) * np.log(p) + (1 - np.nan_to_num(patterns)) * np.log(1 - p)).sum(1)
        return (counts * (fit - (la**2 + b**2) / 2)).sum() - (theta**2).sum() / 2

    best, la = goal(np.log(a), b, theta), np.log(a)
    for part in range(3):
        for i in range(4):
            for step in (-0.02, 0.02):
                moved = [la.copy(), b.copy(), theta.copy()]
                moved[part][i] += step
                assert goal(*moved) < best + 1e-6


def test_redacted_documents_are_spliced(spark):
    texts = ["MRN: 00482913 and (217) 555-2368.", "", None, "nothing here", "Dr. Karen Whitfield, DOB: 02/11/1961; Whitfield agreed 😀 MRN: 00482913"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in render.tag_redacted(detect.detect(rows), "doc_id").collect():
        want, at = "", 0
        for start, end, category, *_ in detect.detect_text(texts[r.doc_id])[0]:
            want, at = f"{want}{texts[r.doc_id][at:start]}[{category}]", end
        assert r.redacted == want + (texts[r.doc_id] or "")[at:]
