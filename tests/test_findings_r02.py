"""What the second round's findings were about, each on tables that showed it."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from maskwright.operators import detect, windows
from maskwright.plans import catalogue, files, more  # noqa: F401  files and more register their queries


def folder(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def oracle(name, where, *tables):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    return c.execute(catalogue.ORACLES[name])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f14_addresses_beside_other_numbers_count(spark, tmp_path):
    texts = ["on +1 (953) 555-8050 68.66.253.95 is", "4495589438270767 42.73.240.87 the", "a.b@example.org or 10.0.0.1", None]
    where = folder(tmp_path, documents={"doc_id": [1, 2, 3, 4], "text": texts})
    got = {r.category: r.n_spans for r in catalogue.QUERIES["document_spans"](spark, where).collect()}
    assert got == {"IP": 3, "EMAIL": 1} == dict(oracle("document_spans", where, "documents").fetchall())


def test_f16_a_zip_that_stands_in_a_record_number(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": [1, 9268, 10290]})
    want = oracle("stand_ins", where, "customer")
    names = [d[0] for d in want.description]
    got = catalogue.QUERIES["stand_ins"](spark, where)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_f15_tails_beyond_a_hundred_thousand(spark):
    from maskwright.operators import stats

    n = spark.range(141_408 + 141_437).selectExpr("cast(id as string) as doc", "id < 141408 as a")
    v = n.selectExpr("doc", "inline(array(struct('a' as system, a as leaked), struct('b' as system, not a as leaked)))")
    r = stats.mcnemar(v, "a", "b").collect()[0]
    assert (r.only_a, r.only_b) == (141_408, 141_437) and round(r.p, 6) == 0.958012


@pytest.mark.parametrize("name", ["rule_matches", "screen_notes", "text_windows", "template_spans", "planted_specs", "detect_notes"])
def test_small_tables_are_dealt_over_all_cores(spark, tmp_path, name):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    assert catalogue.QUERIES[name](spark, where).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_f3_a_text_is_searched_by_the_rule_it_asks_for(spark):
    rows = [(1, "Host 10.1.7.3 logged, a@b.org", r) for r in ("ipv4", "email", "none")] + [(2, None, "ipv4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rule_asked string")
    got = detect.rule_hits(docs, asked="rule_asked").collect()
    assert sorted((r.rule, r.start, r.end) for r in got) == [("email", 22, 29), ("ipv4", 5, 13)]


def test_f2_words_are_split_once_a_text(spark):
    docs = spark.createDataFrame([(1, "a, b")], "doc_id long, text string")
    text = plan(windows.text_chunks(docs, 3))
    assert "aggregate(" not in text and len(re.findall(r"split\(", text)) <= 1


@pytest.mark.parametrize("name", "difficulty_tags leaking_documents over_redaction score_by_category score_overall touched_entities entity_f1 reviewed_spans".split())
def test_no_table_of_texts_or_spans_is_broadcast(spark, tmp_path, name):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    text = plan(catalogue.QUERIES[name](spark, where))
    assert "SortMergeJoin [doc_id" in text and "BroadcastHashJoin [doc_id" not in text


@pytest.mark.parametrize("name", ["first_misses", "miss_contexts"])
def test_only_the_first_misses_are_broadcast(spark, tmp_path, name):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    text = plan(catalogue.QUERIES[name](spark, where))
    assert len(re.findall(r"BroadcastHashJoin \[doc_id", text)) == 1 and "TakeOrderedAndProject" in text


def test_f17_a_note_is_made_once_for_its_spans(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    text = catalogue.QUERIES["template_spans"](spark, where)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(aggregate(" not in text


def test_f5_f12_f29_f32_notes_are_dealt_in_bounded_tasks_and_measured_once(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    assert detect.dealt_by(spark.read.parquet(f"{where}/customer.parquet"), "c_custkey", rows=5).rdd.getNumPartitions() == 8
    made = catalogue.scored(spark, where)[0]._jdf.queryExecution()
    assert "Exchange hashpartitioning(doc_id" not in made.executedPlan().toString()  # texts and spans stay where they are made
    assert "size(transform(" not in made.optimizedPlan().toString()


def test_f18_entities_are_counted_in_one_join(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    assert len(re.findall("SortMergeJoin|CartesianProduct|NestedLoop", plan(catalogue.QUERIES["entity_f1"](spark, where)))) == 1


@pytest.mark.parametrize("name, most", [("response_matrix", 1), ("merged_matrices", 2), ("decode_tokens", 1)])
def test_f22_f23_f34_one_shuffle_in_bounded_tasks(spark, tmp_path, monkeypatch, name, most):
    monkeypatch.setattr(catalogue, "LINES_A_TASK", 5)
    n = range(60)
    where = folder(tmp_path, lineitem={"l_orderkey": [k // 3 for k in n], "l_linenumber": [k % 3 for k in n], "l_partkey": list(n), "l_suppkey": list(n), "l_discount": [k % 11 / 100 for k in n], "l_tax": [k % 9 / 100 for k in n]})
    text = plan(catalogue.QUERIES[name](spark, where))
    assert len(re.findall(r"Exchange hashpartitioning\(.*, 12\), REPARTITION_BY_NUM", text)) == len(re.findall("Exchange ", text)) == most


def test_f27_paths_of_several_lengths(spark):
    import numpy as np

    rng, tags = np.random.default_rng(3), ["O", "B-X", "I-X", "E-X", "S-X"]
    want = {k: rng.random((1 + k % 4, 5)) for k in range(30)}
    rows = [(k, t, row.tolist()) for k, x in want.items() for t, row in reversed(list(enumerate(x)))]
    got = windows.decode_paths(spark.createDataFrame(rows, "doc_id long, tok int, scores array<double>"), tags)
    assert "FlatMapGroupsInPandas" not in plan(got)
    paths = {}
    for r in sorted(got.collect(), key=lambda r: r.tok):
        paths.setdefault(r.doc_id, []).append(r.tag)
    assert paths == {k: windows.viterbi(x, tags) for k, x in want.items()}


def test_f24_predictions_without_key_meet_by_text_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c d")], "doc_id long, text string")
    made = spark.createDataFrame([(1, "a b", [(0, 1, "name")]), (2, "c d", [(2, 3, "mrn")])], "doc_id long, text string, spans array<struct<start: int, end: int, label: string>>")
    got = detect.with_predictions(docs, made)
    # no join of rows that may have no key to the digests of others
    text = plan(got)
    assert text.count("SortMergeJoin") == 2 and "Union" in text
    assert {r.text: [s["category"] for s in r.hits] for r in got.collect()} == {"a b": ["NAME"], "c d": ["MRN"]}


def test_f35_converted_notes_are_joined_by_digest(spark):
    assert "SortMergeJoin [text" not in plan(catalogue.QUERIES["converted_notes"](spark, "/root/testdata/sf0.001"))


def test_f25_f33_nothing_is_made_twice_to_test_its_size(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    for name in ("planted_specs", "parsed_documents"):
        text = catalogue.QUERIES[name](spark, where)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Filter .*size\((concat|filter|transform)\(", text), name


def test_f19_f20_f36_stand_ins_are_put_back_without_a_pattern():
    from maskwright.operators.render import Vault
    from maskwright.operators.rules import RULES
    from maskwright.operators.starts import Index

    v = Vault("k", "surrogate")
    text, _ = v.render("Dr. Karen Whitfield rang (217) 555-2368, Karen", iter([(4, 19, "NAME", False), (25, 39, "PHONE", False), (41, 46, "NAME", False)]))
    v.behind |= {"ab": "x", "abc": "y", "b-c": "z", "-c": "w"}
    for t in (text, text.upper(), f"x{text}_", "ab abc abcd aab-c b-c-c a-c ab_ abab", ""):
        assert v.restore(t) == v.restore(t, v.originals())
    # a rule that begins with a capital isn't tried at other words
    rule = next(r for r in RULES if r.name == "city_state")
    assert Index("so Sue sue", "so sue sue").at[rule.spot] == [3]


def test_f21_sql_calls_detects_once_in_batches_over_all_cores(spark, tmp_path):
    import datetime

    n = range(1, 30)
    where = folder(tmp_path, orders={"o_orderkey": list(n), "o_orderpriority": ["1-URGENT", "email", None] * 9 + ["tel", "5-LOW"], "o_orderdate": [datetime.date(1990 + k, 3, 4) for k in n]})
    want = oracle("sql_calls", where, "orders")
    got = catalogue.QUERIES["sql_calls"](spark, where)
    text = plan(got)
    assert "UDTF" not in text and "Join" not in text and text.count("deid_scan(") == 1
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, got.select(*[d[0] for d in want.description]).collect())) == sorted(want.fetchall())


def test_f21_guards_by_cue_are_the_rules_own():
    from maskwright.operators.rules import CAPITALS, RULES

    texts = ["MRN: 00123456.", "Dr. Karen Whitfield, DOB 03/04/1999, Springfield, IL 62704", "card 4111 1111 1111 1111", "see https://a.b or x@y.org", ""]
    for t in texts:
        told = (t, t.lower(), len(detect.DIGIT.findall(t)), bool(CAPITALS.search(t)))
        assert detect.GUARDS.hopeful(*told) == [r for r in RULES if r.may_match(*told)]
    # texts of one shape are searched by the same rules: a guard asks for any digit or none
    assert all({d for d in keys if d.isdigit()} in (set(), set("0123456789")) and not any(re.search("[0-9]", k) for k in keys if not k.isdigit()) for r in RULES for keys in (r.needs, r.also, r.cased))
    for a, b in (("10.0.0.1 SSN 123-45-6789", "99.9.9.9 SSN 000-45-6789"), ("at 25.2.2.2", "at 29.2.2.2")):
        assert [detect.rule_spans(t) for t in (a, b)] == [[s for r in RULES for s in detect.scan(r, t) if r.may_match(t, t.lower(), len(detect.DIGIT.findall(t)), bool(CAPITALS.search(t)))] for t in (a, b)]


@pytest.mark.parametrize("form", ["report_lines", "report_json"])
def test_f9_f10_a_report_counts_once(spark, form):
    from pyspark.sql import functions as F

    from maskwright.sources import sinks

    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda c: (made.add(1), c)[1])
    rows = spark.createDataFrame([("DATE", 4, 3, 2, 40, 30, 5, 4), ("NAME", 2, 1, 1, 20, 10, 1, 1)], "category string, gold long, caught long, full long, gold_chars long, covered_chars long, predicted long, predicted_correct long")
    text = getattr(sinks, form)(rows.withColumn("category", seen("category")))
    assert made.value == 2 and "DATE" in str(text)


def test_f12_the_sums_of_a_score_are_made_once(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": list(range(1, 40))})
    assert not re.search("CartesianProduct|NestedLoop", plan(catalogue.QUERIES["score_overall"](spark, where)))


def test_f28_notes_of_all_templates_come_from_one_pass(spark, tmp_path):
    where = folder(tmp_path, customer={"c_custkey": [*range(1, 40), None]})
    for name in ("template_notes", "template_spans"):
        made = catalogue.QUERIES[name](spark, where)
        text = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in text and text.count("RepartitionByExpression") == 1, name
        want = oracle(name, where, "customer")
        names = [d[0] for d in want.description]
        rows = [tuple(r) for r in made.where("doc_id IS NOT NULL").select(*names).collect()]
        assert sorted(rows) == sorted(r for r in want.fetchall() if r[0] is not None), name
    assert catalogue.QUERIES["template_notes"](spark, where).where("doc_id IS NULL AND text IS NULL").count() == 8


def test_f6_f11_f30_f31_places_of_spans_are_told_by_widths(spark, tmp_path):
    import duckdb

    from maskwright.plans import notes

    where = folder(tmp_path, customer={"c_custkey": [*range(0, 40), 9_999, 123_456, 5_399_999, 99_999_999, None]})
    gold = notes.tables(spark, where)[1]
    assert "aggregate(" not in gold._jdf.queryExecution().optimizedPlan().toString()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{where}/customer.parquet'")
    want = c.execute(notes.GOLD_SQL).fetchall()
    assert sorted(map(tuple, gold.collect()), key=str) == sorted(want, key=str)
