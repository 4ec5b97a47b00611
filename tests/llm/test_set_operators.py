"""Near-duplicates, repeats, chat packs, WARC archives and top-k search against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import bpe, chat, graph, minhash, repeats, topk, warc
from maskwright.llm.common import fresh_path


def near_texts():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "one two", "Ünïcode Ä word list here now", "ünïcode Ä word list here now"]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randrange(3, 150))
        for _ in range(r.randrange(1, 7)):
            own = base.copy()
            for _ in range(r.randrange(0, 1 + len(own) // 12)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    hot = r.choices(vocabulary, k=60)
    for _ in range(60):
        own = hot.copy()
        for _ in range(r.randrange(0, 5)):
            own[r.randrange(60)] = r.choice(vocabulary)
        texts.append("\t".join(own))
    r.shuffle(texts)
    return texts


def near_brute(texts, k):
    sets = {}
    for i, t in enumerate(texts):
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = near_texts()
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, component long, n string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows, k).collect()} == near_brute(texts, k)
    assert minhash.near_duplicates(rows.limit(0), k).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "OPEN_BLOCK", (60, 1 << 20))
    monkeypatch.setattr(minhash, "BLOCK", (200, 1 << 22))
    monkeypatch.setattr(minhash, "SINGLY", 3)
    monkeypatch.setattr(minhash, "UNSETTLED", 10**9)  # one round of hubs, then blocks
    r = random.Random(5)
    seed = [f"s{i}" for i in range(60)]
    texts = []
    for _ in range(150):  # from near copies to texts that link with nothing
        own = seed.copy()
        for _ in range(r.randrange(0, 16)):
            own[r.randrange(60)] = f"x{r.randrange(400)}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brute = near_brute(texts, 2)
    assert 20 < len({c for _, c in brute.values()}) < 130
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(rows, 2).collect()} == brute


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(5, a), (5, b), (5, a), (3, b + " more"), (None, a), (None, "alone here"), (9, a + " end"), (8, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(rows, 2).collect()), key=str)
    assert got == sorted([(5, 39, 5), (5, 39, 3), (5, 39, 5), (3, 40, 3), (None, 39, 5), (None, 1, None), (9, 40, 5), (8, 0, 8)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=9), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=9))
def test_common_shingles_by_matrix(x, y):
    side = lambda sets: [np.array(sorted(s), dtype=np.uint64) for s in sets]
    assert minhash.in_common(side(x), side(y)).tolist() == [[len(a & b) for b in y] for a in x]


def test_similarity_estimate():
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join([*(f"a{i}" for i in range(280)), *(f"b{i}" for i in range(20))])
    x, y = (minhash.packed(minhash.minima(minhash.shingles(t, 2))) for t in (a, b))
    lanes = sum(bin((v | v >> 1) & 0x5555555555555555).count("1") for v in (x ^ y).view(np.uint64).tolist())
    assert abs(minhash.estimate(1 - lanes / minhash.SIGNED) - 279 / 319) < 0.2
    assert 0 < minhash.least_equal(0.8) < minhash.SIGNED


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), *((100, i) for i in range(101, 140))]
    rows = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in graph.components(rows).collect()}
    assert got == {r.id: r.component for r in graph.components(rows, small=0).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{i: 100 for i in range(100, 140)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_graphs_are_joined_in_one_task(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    rows = spark.createDataFrame(links, "a long, b long")
    by_stars = sorted(graph.components(rows, small=0).collect())
    packs, pack = [], graph.packed
    monkeypatch.setattr(graph, "packed", lambda *a: packs.append(a) or pack(*a))
    assert sorted(graph.components(rows).collect()) == by_stars and not packs
    n = rows.where("a <> b").select(F.greatest("a", "b"), F.least("a", "b")).distinct().count()
    assert sorted(graph.components(rows, small=n).collect()) == by_stars and not packs
    assert sorted(graph.components(rows, small=n - 1).collect()) == by_stars and packs


def repeat_brute(texts):
    n, counts, words = repeats.LEAST, Counter(), {}
    for i, t in enumerate(texts):
        words[i] = (t or "").encode().split()
        counts.update(tuple(words[i][j : j + n]) for j in range(len(words[i]) - n + 1))
    out = []
    for i, w in words.items():
        spans = []
        for j in range(len(w) - n + 1):
            if counts[tuple(w[j : j + n])] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + n
                else:
                    spans.append([j, j + n])
        out += [(i, *s) for s in spans]
    return sorted(out)


def test_repeated_passages(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    line = [word() for _ in range(12)]
    texts = [None, "", "short text", "same " * 120, " ".join(f"u{i}" for i in range(49))]
    for i in range(40):
        body = [word() for _ in range(r.randrange(0, 200))]
        if i % 3:
            at = r.randrange(len(body) + 1)
            body[at:at] = passages[i % 5]
        body[len(body) // 2 : len(body) // 2] = line
        texts.append(" ".join(body))
    texts += [texts[-1]] * 3
    rows = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, start int")
    got = sorted((x.doc_id, x.start_word, x.end_word) for x in repeats.repeated_passages(rows).collect())
    assert got == repeat_brute(texts) and len(got) > 10
    assert repeats.repeated_passages(rows.limit(0)).count() == 0


def some_words(r, n):
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


def with_one_minimiser(r, sizes, least, most):
    """Lists of words of these sizes that together have one minimiser, from `least` to `most`."""
    while True:
        parts = [some_words(r, n) for n in sizes]
        kept = repeats.suffixes(0, " ".join(w for p in parts for w in p))
        if len(kept) == 1 and least <= kept[0][5] <= most:
            return parts


def in_context(r, words):
    """words with 60 words of their own on both sides, so that no other minimiser within them shows what they share."""
    only = repeats.suffixes(0, " ".join(words))[0][5]
    while True:
        text = " ".join(some_words(r, 60) + words + some_words(r, 60))
        if [k[5] - 60 for k in repeats.suffixes(0, text) if 60 <= k[5] < 60 + len(words) - repeats.GRAM + 1] == [only]:
            return text


def check_repeats(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x.doc_id, x.start_word, x.end_word) for x in repeats.repeated_passages(rows).collect())
    assert got == repeat_brute(texts)
    return got


def test_repeats_among_recombined_lines(spark):
    r = random.Random(5)
    x, line, y = with_one_minimiser(r, (20, 20, 20), 20, 32)
    texts = [" ".join(some_words(r, 60) + p + some_words(r, 60)) for _ in range(150) for p in (x + line, line + y)]
    texts += [in_context(r, x + line + y) for _ in range(3)]
    r.shuffle(texts)
    assert len(check_repeats(spark, texts)) == 3


def test_repeats_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE", 12)
    r = random.Random(12)
    hot, line = some_words(r, 70), some_words(r, 55)
    texts = [" ".join(some_words(r, 40) + (hot if i % 3 == 0 else some_words(r, 20)) + (line if i % 4 == 0 else []) + some_words(r, 30)) for i in range(80)]
    texts += ["again " * 200, texts[0], None, ""]
    ranges = repeats.ranges_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(ranges) > 8 and ranges == sorted(ranges)
    assert len(check_repeats(spark, texts)) > 40


def test_lead_in_of_hot_passage(spark):
    r = random.Random(6)
    lead, passage = with_one_minimiser(r, (30, 55), 36, 42)
    texts = [in_context(r, passage) if i % 5 == 0 else " ".join(some_words(r, 150)) for i in range(300)]
    texts += [in_context(r, lead + passage) for _ in range(2)]
    r.shuffle(texts)
    assert sorted(end - start for _, start, end in check_repeats(spark, texts))[-2:] == [85, 85]


@given(st.lists(st.tuples(st.text("us#:\\</turn>\n", max_size=8), st.text("a#\\</turn> \n:", max_size=30)), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(turns):
    assert chat.read_turns("".join(chat.format_turn(*t) for t in turns)) == turns


def test_chat_packs(spark):
    rows = [(c, t, role, text) for c in range(12) for t, (role, text) in enumerate([("system", "be kind"), ("user", f"q{c % 3} </turn> \\ ###"), ("assistant", f"a{c % 4}")])]
    rows += [(50, 1, "assistant", "late"), (50, None, "user", None), (51, 0, None, None), (None, 0, "user", "x"), (50, 1, "assistant", "late")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    convs = chat.conversations(frame)
    for pack_chars in (1, 60, 10**6):
        packs = chat.prefix_packs(convs, pack_chars).collect()
        for p in packs:
            for n in p.nodes:  # positions follow the ancestors, which are all that is attended to
                seen = sum(a.end - a.start for a in n.attends)
                assert n.position == seen and all(a.end <= n.start for a in n.attends)
    shared = sum(len(p.text) for p in chat.prefix_packs(convs, 10**6).collect())
    assert shared < sum(len(chat.format_turn(r[2] or "", r[3] or "")) for r in rows)
    for p in chat.prefix_packs(convs, 60).collect():  # the mask holds assistants' texts and nothing else
        for n in p.nodes:
            role, text = chat.read_turns(p.text[n.start : n.end])[0]
            assert (n.loss is not None) == (role == "assistant")
            assert n.loss is None or chat.unescape(p.text[n.loss.start : n.loss.end]) == text
    encode = bpe.load(bpe.vocabulary()).encode
    packs = chat.prefix_packs(convs, 10**6)
    for p, t in zip(packs.collect(), chat.tokenised(packs, bpe.vocabulary()).collect(), strict=True):
        assert len(t.ids) < sum(len(encode(chat.format_turn(r[2] or "", r[3] or ""))) for r in rows) and t.leaves == p.leaves
        for a, b in zip(p.nodes, t.nodes, strict=True):
            assert b.parent == a.parent and b.position == sum(x.end - x.start for x in b.attends) and (a.loss is None) == (b.loss is None)
            assert a.loss is None or t.ids[b.loss.start : b.loss.end] == encode(p.text[a.loss.start : a.loss.end])
            assert a.loss is not None or t.ids[b.start : b.end] == encode(p.text[a.start : a.end])
    schema = pa.schema([("conv_key", pa.string()), ("formatted", pa.string())])
    got = {r.conv_key: r.formatted for r in chat.unpack(chat.prefix_packs(convs, 60), lambda k, f, loss: (k, f), schema, "conv_key string, formatted string").collect()}
    for r in convs.collect():
        assert chat.read_turns(got[r.conv_key]) == [(t.role, t.text) for t in r.turns]
    assert {r.conv_id: len(r.turns) for r in convs.collect()}[50] == 3
    assert chat.prefix_packs(chat.conversations(frame.limit(0))).count() == 0


@given(st.binary(max_size=9000), st.integers(1, 5000))
@settings(max_examples=60, deadline=None)
def test_chunked_framing(body, size):
    assert warc.unchunked(warc.chunked(body, size)) == body


def test_archives(spark):
    long = "\r\n\r\n" + "é" * 40_000
    pages = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "http://b/ \r\nc", long), (4, "u", long), (5, "u", ""), (6, "u", None), (7, "u", "short"), (8, "u", "short"), (None, "u", "nobody"), (2, None, "x" * 200), (3, "http://b/ \r\nc", long)]
    frame = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    path = fresh_path(spark, "test-warc")
    warc.write_archives(frame, path, segment_bytes=1_000)
    rows = warc.read_archives(spark, path).collect()
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    want: Counter = Counter()
    first: dict = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for p, _, h in pages:
        body = (h or "").encode()
        again = len(body) >= 100 and p is not None and p != first[h]
        want[p, "revisit" if again else "response", first[h] if again else None, len(body), hashlib.sha256(body).hexdigest()] += 1
    assert got == want
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in pages}
    back = warc.with_payloads(warc.read_archives(spark, path)).collect()
    assert len(back) == len(rows) and all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in back)
    empty = fresh_path(spark, "test-warc")
    warc.write_archives(frame.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 1, 16).tolist()) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(60)]
    rows += [(400, None), (401, [float("nan")] * 16), (402, [None] * 16), (403, []), (404, [1.0] * 3), (None, [1.0] * 16), (405, [1e9] * 16), (350, rows[5][1])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    vectors = topk.integer_vectors(frame)
    clean = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    want = defaultdict(list)
    for q in sorted({i for i, _ in clean if i % 50 == 0}):
        qv = min(v for i, v in clean if i == q)
        score = lambda v: sum(a * b for a, b in zip(qv, v))  # noqa: B023, E731
        want[q] = sorted((-score(v), i) for i, v in clean if i != q)[:5]
    got = defaultdict(list)
    for x in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, block=3, shard=100).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.vec_id))
    assert got == want
    huge = topk.integer_vectors(spark.createDataFrame([(i, [s * 3e7] * 384) for i, s in ((0, 1.0), (1, 2.0), (2, 3.0), (3, -1.0), (4, 1e308))], "vec_id long, embedding array<double>"))
    assert [(x.vec_id, x.score) for x in topk.top_k(huge.where("vec_id = 0"), huge, 5).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    assert topk.top_k(vectors.limit(0), vectors, 5).count() == 0 and topk.top_k(few, vectors.limit(0), 5).count() == 0
