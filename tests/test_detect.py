"""Rules, checks of values, names, propagation and the detection stage."""

from __future__ import annotations

import pytest

from maskwright.functions import validators as v
from maskwright.operators import detect as d
from maskwright.operators import names


def found(text, **config):
    spans, _ = d.detect_text(text, d.Config(**config))
    return [(text[a:b], c) for a, b, c, *_ in spans]


CASES = [
    ("Mail jane.doe+x@mail.example.co.uk now", [("jane.doe+x@mail.example.co.uk", "EMAIL")]),
    ("see https://a.example/x?y=1.", [("https://a.example/x?y=1", "URL")]),
    ("host 192.168.240.17 up", [("192.168.240.17", "IP")]),
    ("if 00:1B:44:11:3A:B7 up", [("00:1B:44:11:3A:B7", "DEVICE")]),
    ("(217) 555-0142 ext 33", [("(217) 555-0142 ext 33", "PHONE")]),
    ("+44 20 7946 0958", [("+44 20 7946 0958", "PHONE")]),
    ("Fax no: 416-555-0199", [("416-555-0199", "FAX")]),
    ("SSN 123-45-6789", [("123-45-6789", "SSN")]),
    ("MRN: 00123456", [("00123456", "MRN")]),
    ("Policy number: XJK-88123", [("XJK-88123", "PLAN")]),
    ("card 4111 1111 1111 1111", [("4111 1111 1111 1111", "ACCOUNT")]),
    ("Passport number X1234567", [("X1234567", "LICENSE")]),
    ("VIN 1HGCM82633A004352", [("1HGCM82633A004352", "VEHICLE")]),
    ("Serial number: PJK-00123", [("PJK-00123", "DEVICE")]),
    ("routing 021000021", [("021000021", "ACCOUNT")]),
    ("docket 2:25-cv-01234", [("2:25-cv-01234", "ID")]),
    ("MRN is 3 3 0 9 1 7 7", [("3 3 0 9 1 7 7", "MRN")]),
    ("born 03/14/1961", [("03/14/1961", "DATE")]),
    ("the fourteenth of May 1958", [("the fourteenth of May 1958", "DATE")]),
    ("seen 4/5 today", [("4/5", "DATE")]),
    ("since March", [("March", "DATE")]),
    ("a 93 year old", [("93", "AGE")]),
    ("ninety-three years old", [("ninety-three", "AGE")]),
    ("at 12 Wallaby Way, Apt 4B,", [("12 Wallaby Way, Apt 4B", "ADDRESS")]),
    ("P.O. Box 1234", [("P.O. Box 1234", "ADDRESS")]),
    ("Springfield, IL 62704", [("Springfield", "LOCATION"), ("62704", "ZIP")]),
    ("K1A 0B1", [("K1A 0B1", "ZIP")]),
    ("Dr. Karen Whitfield agreed", [("Karen Whitfield", "NAME")]),
    ("sent to MUELLER, GLORIA.", [("MUELLER, GLORIA", "NAME")]),
    ("her daughter Anneli came", [("Anneli", "NAME")]),
    ("j dot akhtar at example dot com", [("j dot akhtar at example dot com", "EMAIL")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_identifiers(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text", ["BP 120/80, HR 72", "strength 4/5 in both arms", "metoprolol 25 mg BID", "67 year old", "DIABETES, MELLITUS", "PAIN, CHEST", "123-45-0000 is no number", "", "may we go", "ein Haus und ein Garten"])
def test_nothing_to_find(text):
    assert found(text) == []


def test_a_rejected_match_hides_nothing():
    assert found("account number none, account number 12345") == [("12345", "ACCOUNT")]


def test_propagation():
    text = "Dr. Karen Whitfield agreed. Later Whitfield's note and whitfield field. We met Ilse Whitfield."
    names_ = [x for x, _ in found(text)]
    assert names_ == ["Karen Whitfield", "Whitfield", "Ilse Whitfield"]
    assert [x for x, _ in found(text, propagate=False)] == ["Karen Whitfield"]


def test_suspicious_is_only_possible():
    spans, possible = d.detect_text("code AB123456 here")
    assert not spans and [(a, b) for a, b, *_ in possible] == [(5, 13)]


def test_model_hits_policy_and_tidy():
    text = "Acme hired Bob"
    hits = [(0, 4, "ORG", "model", 0.9, False), (11, 14, "NAME", "model", 0.6, False)]
    assert [s[2] for s in d.detect_text(text, d.Config(), hits)[0]] == ["NAME"]
    assert [s[2] for s in d.detect_text(text, d.Config(strict=True), hits)[0]] == ["ORG", "NAME"]
    assert d.tidy("call Dr. Ann", (4, 8, "NAME", "model", 0.5, False)) is None
    assert d.tidy("see Annabel now", (3, 7, "NAME", "model", 0.5, False))[:2] == (4, 11)
    assert d.tidy("he is ninety", (6, 12, "AGE", "model", 0.5, False)) is None
    assert d.effective_threshold(None, 0.2) == 0.2 and d.effective_threshold(0.5, 0.2) == 0.5 and d.effective_threshold(None, 2.0) == 0.35
    assert d.Config().at(0.05).floor == 0.05


def test_checks():
    assert v.luhn("4111 1111 1111 1111") and not v.luhn("4111 1111 1111 1112")
    assert v.valid_vin("1HGCM82633A004352") and not v.valid_vin("1HGCM82633A004353")
    assert v.valid_aba("021000021") and not v.valid_aba("111111111")
    assert v.valid_iban("GB61 BARC 8149 9347 6523 73") and not v.valid_iban("gb61")
    assert names.name_pair("VAN DER BERG, ANNA") and names.name_pair("DAY, RICH")
    assert not names.name_pair("HISTORY, FAMILY") and not names.name_pair("SMITH")


def test_columns_agree_with_python(spark):
    values = ["4111111111111111", "021000021", "123456789", "1HGCM82633A004352", "GB61 BARC 8149 9347 6523 73", "93", "126", "7777777", "000-12-3456", "", "abc", "123-45-6789"]
    rows = spark.createDataFrame([(x,) for x in values], "x string")
    from pyspark.sql import functions as F

    pairs = [(v.is_luhn, v.luhn), (v.is_ssn, v.valid_ssn), (v.is_vin, v.valid_vin), (v.is_aba, v.valid_aba), (v.is_iban, v.valid_iban), (v.is_age_over_89, v.age_over_89), (v.is_not_all_same, v.not_all_same)]
    got = rows.select("x", *[c(F.col("x")).alias(str(i)) for i, (c, _) in enumerate(pairs)]).collect()
    for r in got:
        assert [bool(r[str(i)]) for i in range(len(pairs))] == [bool(f(r.x)) for _, f in pairs], r.x


def test_frames(spark):
    rows = spark.createDataFrame([(1, "MRN: 00123456", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, spare string")
    out = d.detect(rows)
    assert out.columns == ["doc_id", "text", "spare", "spans", "possible"]
    assert [(r.doc_id, r.start, r.end, r.category) for r in d.long_spans(out).collect()] == [(1, 5, 13, "MRN")]
    assert d.detect(rows.limit(0)).count() == 0
    predictions = spark.createDataFrame([(1, "MRN: 00123456", [(5, 13, "MRN")])], "doc_id long, text string, spans array<struct<start: int, end: int, label: string>>")
    assert d.with_predictions(rows.where("doc_id = 1"), predictions).count() == 1
    with pytest.raises(Exception, match="no prediction"):
        d.with_predictions(rows, predictions).collect()
