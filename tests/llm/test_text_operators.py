"""BPE, language ID, toxicity, secrets and decontamination on small rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import bpe, decontaminate, langid, secrets, toxicity

ODD = ["", " ", "\t\n", "a\x1cb\x85c", "it's WE'LL don't", "<|endoftext|> x<|startoftext|>", "12½² 東京 😀😀 Kelvin K", "x" * 5000, "ab" * 400 + "é" * 300, "ΣΑΣ İ"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe_is_the_librarys(library):
    b, r = bpe.load(bpe.vocabulary()), random.Random(7)
    texts = ODD + ["".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(32, 127)])) for _ in range(r.randrange(60))) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert b.encode(t) == ids
        assert b.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_heap_and_scan_agree():
    b, r = bpe.load(bpe.vocabulary()), random.Random(8)
    for _ in range(200):
        parts = [b.vocab[r.choice("aeinorst")] for _ in range(r.randrange(1, 60))]
        assert b.merged(parts.copy()) == b.merged_long(parts.copy())


def test_bpe_frames(spark, library):
    rows = docs(spark, [None, "", "hello world hello", "hello world hello"])
    ids = bpe.encode(rows, bpe.vocabulary())
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    want = library.encode("hello world hello", add_special_tokens=False).ids
    assert got == {0: [], 1: [], 2: want, 3: want}
    back = {r.doc_id: r.text for r in bpe.decode(ids, bpe.vocabulary()).collect()}
    assert back[0] == "" and back[2] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(rows.limit(0), bpe.vocabulary()).count() == 0


def language_rows(spark):
    en = "the house and the garden of the old man with this water that was there for them"
    de = "das haus und der garten des alten mannes mit diesem wasser das dort war für sie"
    return [(2 * i + k, t, lang, "s", 1) for i in range(30) for k, (t, lang) in enumerate([(en, "en"), (de, "de")])]


def test_language_filters(spark):
    rows = spark.createDataFrame([*language_rows(spark), (900, None, "en", "s", 1), (901, "text", None, "s", 1)], DOCS)
    f = langid.train(rows)
    assert f.languages == ["de", "en"]
    assert f.predict("the man with that water")[0] == "en" and f.predict("der mann mit diesem haus")[0] == "de"
    for t in (None, "", "123 !!", "\n"):
        assert f.predict(t) == ("und", 0.0)
    assert all(0 <= f.predict(t)[1] <= 1 for t in ODD)
    kept = langid.keep_identified(spark.createDataFrame([(1, "the old man", "en", "s", 1), (2, None, "en", "s", 1), (3, "99", "en", "s", 1)], DOCS), f, 0.2)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert langid.train(rows.limit(0)).predict("the") == ("und", 0.0)


def plain_language(counts, common, text):
    """The language with the greatest share of the text's n-grams among its typical ones, and that share."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    pieces = re.findall(r"[^\W\d_]+", text.lower())
    grams = [g for p in pieces for w in [f" {p} "] for n in langid.SIZES for g in (w[i : i + n] for i in range(len(w) - n + 1))]
    total = {x: sum(c.values()) for x, c in counts.items()}
    most = {g: max(c[g] / total[x] for x, c in counts.items()) for c in counts.values() for g in c}
    held = {x: {g for g in c if c[g] / total[x] >= max(langid.LEAST_SHARE, langid.LEAST_RATIO * most[g])} for x, c in counts.items()}
    share = {x: sum(g in held[x] for g in grams) / len(grams) for x in sorted(counts)}
    best = max(share, key=lambda x: share[x])
    return (best, share[best]) if share[best] else (common, 0.0)


def test_languages_against_plain_counts(spark):
    r = random.Random(21)
    stock = {x: ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(60)] for x, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "äöüabij"))}
    make = lambda x: " ".join(r.choice(stock[x] if r.random() < 0.8 else stock["aa"]) for _ in range(r.randrange(3, 40)))
    rows = [(i, make(x), x, "s", 1) for i, x in enumerate(["aa", "bb", "cc", "cc"] * 30)]
    filters = langid.train(spark.createDataFrame(rows, DOCS))
    counts = {x: defaultdict(int) for x in stock}
    for _, t, x, *_ in rows:
        for w in (f" {p} " for p in t.split()):
            for n in langid.SIZES:
                for i in range(len(w) - n + 1):
                    counts[x][w[i : i + n]] += 1
    for text in [*(make(x) for x in stock for _ in range(60)), "", "12 !!", "日本 語", "x", "1a2", "Ä", None]:
        want, share = plain_language(counts, "cc", text)
        got, score = filters.predict(text)
        assert got == want and abs(score - share) < 0.05, text
    assert filters.predict("東京は日本の首都です") == ("cc", 0.0)


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    long = "the old man and the garden " * 40_000
    names = "doc_id long, text string, lang string, score double, n long, toxic int, rows long, most double, word string"
    rows = spark.createDataFrame([(1, long, "en", 0.0, 1, 1, 1, 0.0, "w"), (1, long, "en", 0.0, 1, 1, 1, 0.0, "w"), (2, "der alte mann", "de", 0.0, 1, 0, 1, 0.0, "w"), (3, None, None, None, None, None, None, None, None), (4, "", "de", 0.0, 1, 0, 1, 0.0, "w")], names)
    out = [r.lang_pred for r in langid.predictions(rows, langid.train(rows)).orderBy("doc_id").collect()]
    assert out == ["en", "en", "de", "und", "und"]
    m = toxicity.train(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert [r.doc_id for r in toxicity.scored(rows, m).orderBy("doc_id").collect()] == [1, 1, 2, 3, 4]
    assert toxicity.scored(rows.limit(0), m).count() == 0
    assert [r.base for r in secrets.scan(rows).orderBy("doc_id").collect()] == [""] * 5 and secrets.scan(rows.limit(0)).count() == 0
    bench = spark.createDataFrame([(1, "the old man and the garden the old man and")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(rows.withColumn("item_id", rows.n), bench).collect()) == [(1, 1), (1, 1)]
    assert len(bpe.encode(rows, bpe.vocabulary()).orderBy("doc_id").first().ids) == 6 * 40_000


def test_language_masks_hold_every_language():
    f = langid.build({"a": {11: 5, 12: 5}, "b": {12: 5, 13: 5}})
    assert f.masks(np.array([11, 12, 13, 999_999], dtype=np.uint64)).tolist()[:3] == [1, 3, 2]


def brute_segments(s, at=0):
    best = max(((s[i:j].sum(), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    v, i, j = best
    return [*brute_segments(s[:i], at), (at + i, at + j), *brute_segments(s[j:], at + j)]


def test_segments_are_all_maximal_ones():
    r = np.random.default_rng(1)
    for _ in range(200):
        s = r.normal(-0.3, 1, r.integers(0, 13))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)


def test_toxicity_learns_words(spark):
    r = random.Random(3)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = r.choices(plain, k=80)
        if toxic:
            for at in range(10, 60, 10):
                words[at] = "vile"
        rows.append((i, " ".join(x.replace("w", "w" + "abcdefghij"[int(x[-1])]) if x != "vile" else x for x in words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(frame, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    assert m.score(rows[0][1]) > 0.7 > m.score(rows[1][1])
    assert m.score(None) == m.score("") == m.score("12") and 0 <= m.score("vile") <= 1
    assert m.passages(rows[0][1])
    out = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([(1, None), (2, rows[0][1])], "doc_id long, text string"), m).collect()}
    assert out[1].passages == [] and out[2].score > 0.7
    empty = toxicity.train(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.score("vile") < 0.01


def test_more_languages_than_a_word_has_bits(spark):
    r = random.Random(9)
    names = [f"l{i:03}" for i in range(130)]
    own = {x: ["".join(chr(0x4E00 + 40 * i + r.randrange(40)) for _ in range(4)) for _ in range(20)] for i, x in enumerate(names)}
    rows = [(i, " ".join(r.choices(own[x], k=30)), x) for i, x in enumerate(names * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(frame)
    assert filters.languages == names and [filters.predict(t)[0] for _, t, _ in rows] == [x for *_, x in rows]
    assert {r.doc_id: r.lang_pred for r in langid.predictions(frame, filters).collect()} == {i: x for i, _, x in rows}


def plain_secrets(x):
    found = []
    for i, (p, n, g) in enumerate([(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]):
        found += [(m.start(), i, m.end()) for m in re.finditer(p, x, (re.I | re.A) if i == 0 else 0) if len(m[g]) >= n]
    return sorted(found)


@given(st.lists(st.sampled_from(["token", "Secret", "API_key", "passwd", "=", ":", " ", "'", '"', "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef0123456789abcdef", "ſecret", "toKen", "é", "\n", "zz"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_secrets(x):
    assert secrets.base_spans(x) == plain_secrets(x)


def plain_bits(value, ranks):
    """The cheapest of all segmentations, each segment's kinds told by their definitions."""
    plain, low = value.lower().translate(secrets.LOOKALIKE), value.lower()
    per = np.log2(secrets.alphabet(value))

    def costs(i, j):
        part, n = value[i:j], j - i
        if n == 1:
            yield per
            if part in secrets.SIGNS:
                yield secrets.SIGN_BITS
        whole_run = n >= 3 and len(set(low[i:j])) == 1 and (i == 0 or low[i - 1] != low[i]) and (j == len(value) or low[j] != low[i])
        if whole_run:
            yield per + np.log2(n) + 1
        walk = lambda k: low[k] in secrets.NEAR.get(low[k - 1], ())
        if n >= 4 and all(walk(k) for k in range(i + 1, j)) and (i == 0 or not walk(i)) and (j == len(value) or not walk(j)):
            yield np.log2(47 * 8) + n
        if n >= 3 and plain[i:j] in ranks:
            changed = sum(a != b for a, b in zip(part, plain[i:j]))
            yield np.log2(ranks[plain[i:j]]) + 1 + min(changed, n - changed + 1)
        if (m := secrets.DATE.match(value, i)) and m.end() == j:
            yield np.log2(36_500 if n > 4 else 100)
        if part[0] in "hH@" and (m := secrets.HOST.match(value, i)) and m.end() == j:
            yield secrets.HOST_BITS
        for width in range(2, 9):
            k = n // width
            if k >= 2 and n == k * width and part == part[:width] * k and value[j : j + width] != part[:width]:
                yield width * per + np.log2(k) + 1

    best = [0.0] + [np.inf] * len(value)
    for j in range(1, len(value) + 1):
        best[j] = min([best[i] + c for i in range(j) for c in costs(i, j)], default=np.inf)
    return best[-1]


@given(st.lists(st.sampled_from(["ab", "a", "aaa", "1", "qwer", "asdf", "2020-01-01", "1999", "password", "p4ss", "-", "x9", "@a.b", "Key", "abab", "123123", "Z"]), min_size=1, max_size=7).map("".join))
@settings(max_examples=300, deadline=None)
def test_guess_bits_against_every_segmentation(value):
    assert abs(secrets.guess_bits(value) - plain_bits(value, secrets.fixed_ranks())) < 1e-6


def test_guess_costs_and_spans():
    bits = secrets.guess_bits
    assert bits("password") < bits("password123") < bits("x9$Kq!2mZr") and bits("aaaaaaaaaaaa") < 15 and bits("qwertyuiop") < 25
    assert bits("2020-01-01") < bits("zv7-kq2-xm") and bits("abcabcabcabc") < bits("abcqwzrtplmx")
    assert secrets.guess_spans("passphrase: x9$Kq!2mZr7&") and not secrets.guess_spans("passphrase: monkey123")
    assert not secrets.guess_spans("nothing x9$Kq!2mZr7& here: and")
    assert bits("a1" * 50_000) > 0


@pytest.mark.parametrize("before", ["client_key" + 10 * " " + "= ", "pwd\t:\t", "passphrase" + 40 * " " + ":=" + 40 * " ", "Authorization: Bearer ", "authorization = 'Basic\t ", '"Authorization": "bearer '])
def test_contexts_of_any_width_and_scheme(before):
    value = "x9Kq2mZr7aa8"
    assert secrets.guess_spans(f"{before}{value} end") == [(len(before), 3, len(before) + len(value))]
    assert secrets.redact(f"{before}{value} end") == f"{before}[SECRET] end"


@pytest.mark.parametrize("clean", ["Pin: section-heading", "pin: kitchen/street", "login: anna.smith@example.com", "auth: https://www.example.com/login"])
def test_clean_words_and_addresses_after_cues(clean):
    assert not secrets.guess_spans(clean) and secrets.redact(clean) == clean


def test_words_of_the_corpus_are_cheap(spark):
    rows = docs(spark, [*["Grünkohlsuppe und Zwetschgenknödel"] * 6, "pin: Grünkohlsuppe/Zwetschgenknödel", "pin: x9Kq2mZr7aa8", *["pwd: Qvx-wzjkpq-hgtr-wq"] * 6])
    red = [r.text for r in secrets.redact_secrets(rows).orderBy("doc_id").collect()]
    assert red[6:] == ["pin: Grünkohlsuppe/Zwetschgenknödel", "pin: [SECRET]", *["pwd: [SECRET]"] * 6]
    assert [r.n_guess for r in secrets.scan(rows).orderBy("doc_id").collect()][6:] == [0, 1, *[1] * 6]


def test_secret_frames(spark):
    rows = docs(spark, [None, "", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "clean"])
    out = {r.doc_id: r for r in secrets.scan(rows).collect()}
    assert (out[0].base, out[1].spans, out[3].n_assign) == ("", "", 0)
    assert out[2].base == "assign:0:50,hex:9:49".replace("assign:0:50", "assign:0:49") and out[2].n_hex == 1 and out[2].n_guess == 1
    red = {r.doc_id: r for r in secrets.redact_secrets(rows).collect()}
    assert red[0].text is None and red[2].text == '[SECRET]" end' and red[2].n_chars == len(red[2].text) and red[3].text == "clean"


def edit(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, e in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return min(prev)


@given(st.text("ab c", min_size=1, max_size=40), st.text("ab c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(p, t):
    masks = defaultdict(int)
    for i, c in enumerate(p):
        masks[c] |= 1 << i
    assert decontaminate.distance(p, masks, t)[0] == edit(p, t)


def test_contamination_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randrange(6, 30)))) for i in range(12)] + [(90, None), (91, "..."), (92, "tiny one")]
    texts = []
    for i in range(60):
        body = [word() for _ in range(40)]
        if i % 2:
            leak = list(r.choice(items[:12])[1].upper())
            for _ in range(r.randrange(0, 14)):
                leak[r.randrange(len(leak))] = r.choice("xyz")
            body.insert(r.randrange(40), "".join(leak))
        texts.append(" ".join(body) + (" Tiny, one!" if i % 10 == 0 else ""))
    texts += [None, "", "  ", "tinyone"]
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            p, n = decontaminate.normal(item), decontaminate.normal(t)
            if p and n and edit(p, n) <= decontaminate.errors_of(len(p)):
                want[d, i] = edit(p, n)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and any(v > 0 for v in want.values())
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    blocks = list(decontaminate.item_blocks(bench, 200))
    assert len(blocks) > 1 and sorted(x for b in blocks for x in b) == sorted((i, t) for i, t in items if t is not None)
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_digests_are_of_the_empty_text():
    b = bpe.load(bpe.vocabulary())
    assert bpe.digests(b, [], "")[1:] == (hashlib.sha256(b"").hexdigest(),) * 2
