"""Synthetic notes with planted identifiers: formats, specs, substitution, verification screens, difficulty tags, mixing."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from .detect import rule_spans
from .formats import format_regex, infer_format, novel, sample_format  # noqa: F401  the format language, here as well
from .names import COMMON, NAME_STOP
from .render import TITLES

# --- planted text ----------------------------------------------------------------------------------------------------


def substitute(raw: DataFrame) -> DataFrame:
    """(doc_id, text, spans, problems) of raw(doc_id, text, planted array<struct<ph, value, label, count>>).

    Sentinels [[PH]] are replaced by their values, so gold offsets hold by construction; wholly native. Problems are unknown
    sentinels, values named fewer times than asked for, and brackets left over.
    """
    parts = F.split("text", r"(?=\[\[[A-Z0-9_]+\]\])|(?<=\]\])")
    x = raw.withColumn("values", F.map_from_entries(F.transform("planted", lambda p: F.struct(p["ph"], p)))).withColumn("parts", parts)
    ph = lambda p: F.regexp_extract(p, r"^\[\[([A-Z0-9_]+)\]\]$", 1)
    piece = F.transform("parts", lambda p: F.struct(F.when(ph(p) != "", F.element_at("values", ph(p)).getField("value")).otherwise(p).alias("out"), F.when(ph(p) != "", ph(p)).alias("ph")))
    x = x.withColumn("pieces", piece)
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int, label: string>>))")
    size = lambda q: F.length(F.coalesce(q["out"], F.lit("")))
    step = lambda acc, q: F.struct((acc["at"] + size(q)).alias("at"), F.when(q["ph"].isNotNull() & q["out"].isNotNull(), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + size(q)).alias("end"), F.element_at("values", q["ph"]).getField("label").alias("label"))))).otherwise(acc["spans"]).alias("spans"))
    unknown = F.transform(F.filter("pieces", lambda q: q["ph"].isNotNull() & q["out"].isNull()), lambda q: F.concat(F.lit("unknown "), q["ph"]))
    few = F.transform(F.filter("planted", lambda p: F.size(F.filter("pieces", lambda q: q["ph"] == p["ph"])) < p["count"]), lambda p: F.concat(F.lit("missing "), p["ph"]))
    left = F.when(F.exists("pieces", lambda q: q["ph"].isNull() & q["out"].rlike(r"\[\[|\]\]")), F.array(F.lit("brackets"))).otherwise(F.array().cast("array<string>"))
    return x.select("doc_id", F.array_join(F.transform("pieces", lambda q: F.coalesce(q["out"], F.lit(""))), "").alias("text"), F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("spans"), F.concat(unknown, few, left).alias("problems"))


def verbatim_places(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of docs(doc_id, text, values array<struct<value, label>>): where the values stand in the texts."""
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "label": x} for s, e, x in verbatim(t or "", [(v["value"], v["label"]) for v in vs or []])] for t, vs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "values").mapInArrow(run, f"doc_id {kind}, spans array<struct<start: int, end: int, label: string>>")


def verbatim(text: str, values: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Word-bounded places of planted values in a text, longer ones first where they overlap."""
    found = [(m.start(), m.end(), label) for value, label in values if value for m in re.finditer(rf"(?<!\w){re.escape(value)}(?!\w)", text)]
    kept: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


#: Shapes that must not stand outside planted spans, with the name of the screen.
SCREENS = [
    ("digits", re.compile(r"(?<![\d.])\d{4,}(?!\.?\d)|\b\d{1,3}(?:,\d{3})+\b")),
    ("date-like", re.compile(rf"\b\d{{1,2}}[/-]\d{{1,2}}(?:[/-]\d{{2,4}})?\b|\b(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*\.? \d{{1,2}}\b")),
    ("time", re.compile(r"\b\d{1,2}:\d{2}\b")),
    ("phone", re.compile(r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b|\(\d{3}\) ?\d{3}-\d{4}")),
    ("email", re.compile(r"\S+@\S+\.\w+")),
    ("url", re.compile(r"https?://|www\.")),
    ("ip", re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")),
    ("institution", re.compile(r"\b[A-Z][a-z]+ (?:Hospital|Clinic|Medical Center|University|Institute)\b")),
]
UNIT = re.compile(r"\s{0,2}(?:mg|mcg|ml|units?|mmol|cells|steps|kcal|iu|/)", re.IGNORECASE)
CAPITALISED = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])+")
SENTENCE_ENDS = ".!?;:\n\"»"


@dataclass(frozen=True)
class Pools:
    """What must not stand outside planted spans: real names, common names, and phrases; and common names that are words, too."""

    names: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    ambiguous: frozenset[str] = frozenset()
    phrases: tuple[str, ...] = ()


def opens_sentence(text: str, at: int) -> bool:
    """Whether a word at `at` begins a sentence; the full stop of a title before it ends none."""
    lead = text[:at].rstrip(" \t\n") if at < 64 else text[at - 64 : at].rstrip(" \t\n")
    if not lead:
        return at < 64 or not text[:at].strip()
    title = re.search(r"([^\W\d_]*)\.$", lead)
    return lead[-1] in SENTENCE_ENDS and not (title and title[1].lower() in TITLES)


def screen_text(text: str | None, spans: list[tuple[int, int]], pools: Pools = Pools()) -> list[tuple[str, str, int]]:
    """(reason, match, position) of whatever looks like an identifier outside spans, the detector's own finds included."""
    out, outside = [], lambda a, b: not any(s < b and a < e for s, e in spans)
    text = text or ""
    if not text.strip():
        return [("empty-text", "", 0)]
    for reason, shape in SCREENS:
        for m in shape.finditer(text):
            dose = reason == "digits" and UNIT.match(text, m.end())
            pressure = reason == "date-like" and (p := re.fullmatch(r"(\d{2,3})/(\d{2,3})", m[0])) and 70 <= int(p[1]) <= 250 and 30 <= int(p[2]) <= 150
            if outside(*m.span()) and not dose and not pressure:
                out.append((reason, m[0], m.start()))
    for m in CAPITALISED.finditer(text) if pools.names or pools.common else ():
        word = m[0].lower()
        if m[0][0].isupper() and outside(*m.span()):
            opens = opens_sentence(text, m.start())
            if word in pools.names and not (opens and word in NAME_STOP):
                out.append(("name-pool", m[0], m.start()))
            elif word in pools.common and not (opens and word in pools.ambiguous):
                out.append(("common-name", m[0], m.start()))
    for phrase in pools.phrases:
        out += [("pool-phrase", phrase, m.start()) for m in re.finditer(rf"(?<!\w){re.escape(phrase)}(?!\w)", text) if outside(*m.span())]
    out += [("engine", text[a:b], a) for a, b, *_ in rule_spans(text) if outside(a, b)]
    return out


#: Own phrases of the request for a text; a reply that holds one repeats what it was told.
INSTRUCTIONS = ("use each placeholder", "do not invent", "write a clinical note", "the following placeholders", "as an ai")


def echoes(raw: str | None, planted: list[dict], text: str, spans: list[tuple[int, int]]) -> list[str]:
    """Why a reply echoes its request: phrases of it, planted values beside their places, or the list of placeholders."""
    raw, out = raw or "", []
    out += [f"instruction-echo:{p.split()[0]}" for p in INSTRUCTIONS if p in raw.lower()]
    for item in planted:
        found = re.finditer(rf"(?<!\w){re.escape(item['value'])}(?!\w)", text) if item["value"] else ()
        out += [f"value-echo:{item['ph']}" for m in found if not any(s < m.end() and m.start() < e for s, e in spans)]
    names, values = {i["ph"] for i in planted}, {i["value"] for i in planted}
    listed = 0
    for line in map(str.strip, raw.splitlines()):
        mark, core = re.match(r"\[\[([A-Z0-9_]+)\]\]\s*(=|$)", line), line.strip(" .;-*")
        listed += bool(mark and mark[1] in names) or core in values or (" (" in core and core.split(" (")[0] in values)
    return [*out, "echoed-value-list"] if listed >= 3 else out


def screened(docs: DataFrame, pools: Pools = Pools()) -> DataFrame:
    """docs(doc_id, text, spans) with `reasons`; accepted where it is empty."""
    shape = pa.list_(pa.struct([("reason", pa.string()), ("match", pa.string()), ("at", pa.int32())]))

    def run(batches):
        for b in batches:
            texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            found = [[{"reason": r, "match": m, "at": a} for r, m, a in screen_text(t, [(s["start"], s["end"]) for s in x or []], pools)] for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], names=["doc_id", "reasons"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, reasons array<struct<reason: string, match: string, at: int>>")


def parity_split(key: Column) -> Column:
    """dev for keys whose sha256 is even, sealed for odd ones."""
    return F.when(F.substring(F.sha2(key.cast("string"), 256), -1, 1).isin(*"02468ace"), "dev").otherwise("sealed")


#: Words before a span that give it away.
CUE = r"(?i)(mrn|dob|born|phone|tel|fax|email|ssn|member|account|id|number|no\.|#|dr\.?|mr\.?|mrs\.?|ms\.?|patient|name|lives at|address|zip|license|plate|vin|serial)[^a-z0-9]{0,6}$"


#: More words that give a span away, by label.
LABEL_CUES = {"NAME": "named|known as|signed", "ORG": r"inc\.?|corp\.?|ltd\.?|llp|llc|group|company|university|hospital|clinic|bank|school", "DATE": "as of|dated|effective|due", "AGE": "aged?|years? old|y/?o|age", "ADDRESS": r"residen\w*|located|liv\w+|mov\w+", "LOCATION": r"located|liv\w+|mov\w+", "ZIP": "zip|postal|postcode", "PHONE": "call|tel|mobile|cell|reach", "EMAIL": r"e-?mail\w*|write", "SSN": "tax ?id|security", "MRN": "chart", "PLAN": r"policy|coverage|insur\w*", "ACCOUNT": "acct|deposit|wire|refund|card", "LICENSE": "permit|registration", "VEHICLE": "plate|vehicle|vin|car|truck|auto", "DEVICE": "implant|pacemaker|model", "URL": "link|portal|site|website|http|online", "IP": "host|server", "ID": "password|access", "BIOMETRIC": "fingerprint|biometric|scan|print"}
COMMON_WORD = "(?i)(?:^|[^a-z])(?:" + "|".join(sorted(COMMON)) + ")(?:[^a-z]|$)"


def difficulty_tags(spans: DataFrame) -> DataFrame:
    """spans(doc_id, start, end, label, text) with sorted m:* tags: cue, single name, common word as a name, lower case, spaced
    digits, and whether the text has the same value before."""
    value = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    before = F.substr("text", F.greatest(F.col("start") - 28, F.lit(0)) + 1, F.least(F.col("start"), F.lit(28)))
    label = F.upper("label")
    cued = before.rlike(CUE)
    for name, words in LABEL_CUES.items():
        cued = cued | (label.contains(name) & before.rlike(rf"(?i)(?:\b(?:{words})\b)[\s:#,(]*$"))
    name = label.contains("NAME") | label.contains("PERSON") | label.contains("PATIENT") | label.contains("DOCTOR")
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    seen = F.concat(F.lit(" "), F.regexp_replace(plain(F.substr("text", F.lit(1), F.col("start"))), r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    norm = F.concat(F.lit(" "), F.regexp_replace(F.trim(plain(value)), r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    letters = F.regexp_replace(value, r"\s+", "")
    tags = [F.when(cued, "m:cue").otherwise("m:no_cue"), F.when(name & ~F.trim(value).rlike(r"\s"), "m:single_name"), F.when(name & value.rlike(COMMON_WORD), "m:common_word_name"), F.when(letters.rlike(r"^\p{L}+$") & (letters == F.lower(letters)), "m:lower"), F.when(F.trim(value).rlike("^[0-9]( [0-9])+$"), "m:digit_spaced"), F.when(seen.contains(norm), "m:repeat")]
    return spans.withColumn("tags", F.array_sort(F.array_compact(F.array(*tags))))


def shared_values(a: DataFrame, b: DataFrame, column: str = "value") -> DataFrame:
    """Values, in lower case, that both sides hold: none may be where training and test must differ."""
    low = lambda df: df.select(F.lower(column).alias("value")).where("value IS NOT NULL").distinct()
    return low(a).join(low(b), "value", "left_semi")


#: Confusable characters of scans.
CONFUSED = ("O0", "l1", "S5", "B8", "Z2")


def scan_noise(text: Column, key: Column, seed: int = 0, share: float = 0.35) -> Column:
    """One confusable character changed in a share of texts, by hash."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000))
    out = text
    for i, (a, b) in enumerate(CONFUSED):
        out = F.when((h < int(share * 10_000)) & (h % len(CONFUSED) == i), F.regexp_replace(text, f"^([^{a}]*){a}", f"$1{b}")).otherwise(out)
    return out


def mix(sources: dict[str, DataFrame], shares: dict[str, float], total: int, key: str, seed: int = 0) -> DataFrame:
    """total rows of the sources by their shares (largest remainders), taken and ordered by hash of (seed, key)."""
    floors = {k: total * v / sum(shares.values()) for k, v in shares.items()}
    n = {k: int(x) for k, x in floors.items()}
    for k in sorted(floors, key=lambda k: (n[k] - floors[k], k))[: total - sum(n.values())]:
        n[k] += 1
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    out = None
    for k, df in sources.items():
        taken = df.withColumn("source", F.lit(k)).orderBy(order, key).limit(n[k])
        out = taken if out is None else out.unionByName(taken)
    return out


def shared_by_pools(pools: dict[str, DataFrame], column: str = "value") -> DataFrame:
    """(a, b, value): values that two of some pools hold, in lower case; none where pools are kept apart."""
    all_ = None
    for name, df in pools.items():
        one = df.select(F.lit(name).alias("pool"), F.lower(column).alias("value")).where("value IS NOT NULL").distinct()
        all_ = one if all_ is None else all_.unionByName(one)
    held = all_.groupBy("value").agg(F.array_sort(F.collect_set("pool")).alias("p")).where(F.size("p") > 1)
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select("value", F.inline(pairs)).select("a", "b", "value")


def trainable(rows: DataFrame, column: str = "split") -> DataFrame:
    """rows, failing at one whose split is known and isn't train."""
    sound = F.assert_true(F.coalesce(F.col(column), F.lit("train")) == "train", F.concat(F.lit("split must not be trained on: "), F.col(column)))
    return rows.where(sound.isNull())


def refuse_sealed(paths: list[str]) -> None:
    """ValueError for a path that names sealed documents anywhere."""
    for p in paths:
        if "sealed" in p:
            raise ValueError(f"{p} is sealed")


def refuse_paths(paths: list[str], banned: tuple[str, ...] = ("sealed", "dev", "clin_test", "clin_novel")) -> None:
    """ValueError for a path whose file name says that it must not be trained on."""
    for p in paths:
        if any(b in p.rsplit("/", 1)[-1] for b in banned):
            raise ValueError(f"{p} must not be used for training")


def unfinished(specs: DataFrame, raws: DataFrame) -> DataFrame:
    """Specs without a generated text; errors count as none."""
    return specs.join(raws.where("finish_reason = 'stop'"), "doc_id", "left_anti")


def verified(specs: DataFrame, raws: DataFrame, pools: Pools = Pools()) -> DataFrame:
    """(doc_id, text, spans, split, problems) of specs(doc_id, planted) and raws(doc_id, seq, text, finish_reason).

    The last text of a spec counts; a missing one, an unfinished one, substitution problems and screens are the reasons for
    which a document is rejected; it is accepted where problems is empty.
    """
    last = raws.groupBy("doc_id").agg(F.max_by(F.struct("text", "finish_reason"), "seq").alias("raw"))
    joined = specs.select("doc_id", "planted").join(last, "doc_id", "left")
    made = substitute(joined.select("doc_id", F.coalesce("raw.text", F.lit("")).alias("text"), "planted"))
    told = made.join(joined.select("doc_id", "planted", F.col("raw.text").alias("reply")), "doc_id")

    def echoed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [echoes(raw, planted or [], t or "", [(x["start"], x["end"]) for x in s or []]) for t, s, planted, raw in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "echoes"])

    echo = told.select("doc_id", "text", "spans", "planted", "reply").mapInArrow(echoed, f"doc_id {specs.schema['doc_id'].dataType.simpleString()}, echoes array<string>")
    seen = screened(made, pools).select("doc_id", F.transform("reasons", lambda r: r["reason"]).alias("screens"))
    why = F.when(F.col("raw").isNull(), F.array(F.lit("no-raw-output"))).when(F.col("raw.finish_reason") != "stop", F.array(F.lit("finish"))).otherwise(F.array().cast("array<string>"))
    out = made.join(seen, "doc_id").join(echo, "doc_id").join(joined.select("doc_id", why.alias("why")), "doc_id")
    return out.select("doc_id", "text", "spans", parity_split(F.col("doc_id")).alias("split"), F.when(F.size("why") > 0, F.col("why")).otherwise(F.array_distinct(F.concat("problems", "echoes", "screens"))).alias("problems"))


def reject_counts(checked: DataFrame) -> DataFrame:
    """Reasons by how many documents they reject, most frequent first."""
    return checked.select(F.explode("problems").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


#: Sentences that carry a value, plain ones, and ones that only look like identifiers.
CARRIERS = ["Record number {} was opened.", "Please quote {} when calling.", "{} is on file.", "We reached them at {}.", "Form lists {} as given."]
PLAIN = ["The visit was short.", "No complaints today.", "Family was present.", "Plan reviewed and agreed."]
HARD = ["BP 120/80, HR 72.", "Strength 4/5 in both arms.", "Took 500 mg twice.", "Score was 12 of 30.", "See section 12(b)."]


def carrier_notes(spark: SparkSession, n: int, seed: int, formats: list[tuple[str, str]], partitions: int | None = None) -> DataFrame:
    """(doc_id, text, spans) of n notes of 3 to 8 sentences: 55 % with a value of formats (label, format), 23 % plain, 22 % hard."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                r = random.Random(hashlib.sha256(f"carrier:{seed}:{i}".encode()).digest())
                text, spans = "", []
                for j in range(r.randrange(3, 9)):
                    u, lead = r.random(), " " if text else ""
                    if u < 0.55:
                        label, pattern = r.choice(formats)
                        value, (before, after) = sample_format(pattern, f"{seed}:{i}:{j}"), r.choice(CARRIERS).split("{}")
                        start = len(text) + len(lead) + len(before)
                        spans.append({"start": start, "end": start + len(value), "label": label})
                        text += f"{lead}{before}{value}{after}"
                    else:
                        text += lead + r.choice(PLAIN if u < 0.78 else HARD)
                rows.append({"doc_id": i, "text": text, "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))]))

    return spark.range(0, n, 1, partitions).mapInArrow(run, "doc_id bigint, text string, spans array<struct<start: int, end: int, label: string>>")


def revalued(planted: list[dict], formats: dict[str, list[tuple[str, str]]], seed: int, key: str) -> list[dict]:
    """Planted items with values of test formats (name, format) where their label has any: tags say which format."""
    out = []
    for i, p in enumerate(planted):
        if choices := formats.get(p["label"]):
            r = random.Random(hashlib.sha256(f"novel:{seed}:{key}:{i}".encode()).digest())
            name, pattern = r.choice(choices)
            tags = [t for t in p.get("tags", []) if t != "spoken" and not t.startswith("fmt:")]
            p = {**p, "value": sample_format(pattern, f"novel:{seed}:{key}:{i}"), "tags": [*tags, "novel_format", f"fmt:{name}"]}
        out.append(p)
    return out


def revalued_items(docs: DataFrame, formats: dict[str, list[tuple[str, str]]], seed: int) -> DataFrame:
    """(doc_id, planted) of docs(doc_id, planted array<struct<label, value, tags>>), with values of new formats where there are any."""
    shape = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string()), ("tags", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [revalued([{**i, "tags": i["tags"] or []} for i in items or []], formats, seed, str(key)) for key, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, shape)], names=["doc_id", "planted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "planted").mapInArrow(run, f"doc_id {kind}, planted array<struct<label: string, value: string, tags: array<string>>>")
