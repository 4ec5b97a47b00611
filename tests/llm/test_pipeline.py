"""The pipeline against a plain Python version, and the registered queries' shapes."""

from __future__ import annotations

import random

import corpus_pipeline
from maskwright.llm import bpe, decontaminate, langid, queries, secrets

from .test_set_operators import near_brute
from .test_text_operators import edit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(17)
    en = "the house and garden of old man with this water that was there for them when rain came down over hills".split()
    de = "das haus und der garten des alten mannes mit diesem wasser dort war für sie als regen kam über hügel".split()
    bench = [(i, " ".join(r.choices(en, k=18))) for i in range(4)] + [(9, None)]
    texts = []
    for i in range(60):
        body = r.choices(en if i % 2 else de, k=r.randrange(30, 90))
        if i % 9 == 0:
            body[10:10] = bench[i % 4][1].split()
        if i % 7 == 0:
            body.insert(5, f'token = "{r.getrandbits(160):040x}"')
        texts.append((" ".join(body), "en" if i % 2 else "de"))
        if i % 5 == 0:
            near = body.copy()
            near[-1] = "end"
            texts += [(" ".join(near), "en" if i % 2 else "de"), (" ".join(body), "en" if i % 2 else "de")]
    texts += [(None, "en"), ("", "en"), ("12 34 !!", None), ("the old man", None)]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)], bench


def test_run_is_the_plain_version(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.lang, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    filters = langid.train(spark.createDataFrame(rows, DOCS))
    kept = [r for r in rows if filters.predict(r[1])[0] != "und" and filters.predict(r[1])[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    groups = near_brute([r[1] for r in kept], corpus_pipeline.SHINGLE)
    kept = [r for i, r in enumerate(kept) if groups[i][1] == i]
    leaks = lambda t: any(decontaminate.normal(x) and edit(decontaminate.normal(x), decontaminate.normal(t)) <= decontaminate.errors_of(len(decontaminate.normal(x))) for _, x in bench)
    kept = [r for r in kept if not leaks(r[1])]
    encode = bpe.load(bpe.vocabulary()).encode
    assert got == {r[0]: (r[2], len(ids), ids) for r in kept if (ids := encode(secrets.redact(r[1]))) is not None}
    assert 20 < len(got) < len(rows) - 15


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([*rows[:6], rows[0], (None, rows[1][1], "en", "s", 5)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    near = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 0 for r in near) <= 1 and sum(r.doc_id is None for r in near) == 1


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 11)) and "pipeline" in queries.QUERIES
