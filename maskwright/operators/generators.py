"""Specs of documents to be written and whole synthetic notes: a document is a function of (seed, id) alone.

Whatever is drawn is a part: a list of choices and the name of its draw, so the same rows come from Catalyst, where parts are
literals under higher-order functions (whole notes from templates: from an Arrow stage), and from `*_sql`, which spells them out
for another engine. Nothing is shuffled, and no document depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FAMILY, GIVEN, draw_sql, pick_sql, pieces_of

try:
    from _sha2 import sha256  # for short strings about twice as fast as hashlib's, which looks the method up each time
except ImportError:
    from hashlib import sha256


@dataclass(frozen=True)
class Part:
    """One of some strings, by the draw of that name; a single string is a literal."""

    choices: tuple[str, ...]
    draw: str = ""


def lit(text: str) -> Part:
    return Part((text,))


def parts_of(pattern: str) -> tuple[Part, ...]:
    return tuple(lit(p) if isinstance(p, str) else Part(tuple(p), str(k)) for k, p in enumerate(pieces_of(pattern)))


_given, _family = Part(tuple(GIVEN), "f"), Part(tuple(FAMILY), "l")
#: Forms of one person's name: the same draws, so that all forms in a document agree.
FORMS: dict[str, tuple[Part, ...]] = {
    "full": (_given, lit(" "), _family),
    "last": (_family,),
    "first": (_given,),
    "initial": (Part(tuple(g[0] for g in GIVEN), "f"), lit(". "), _family),
    "last_first": (Part(tuple(f.upper() for f in FAMILY), "l"), lit(", "), Part(tuple(g.upper() for g in GIVEN), "f")),
    "last_first_title": (_family, lit(", "), _given),
}
SUFFIX = {"full": "", "last": "_LAST", "first": "_FIRST", "initial": "_INIT", "last_first": "_LF", "last_first_title": "_LFT"}
ROADS, PLACES = "Birch Cedar Elder Hazel Maple Poplar Rowan Willow".split(), "Ashmere Bellhaven Dunwick Foxglove Greywater Ivywood Lowmoor Westerby".split()


Forms = tuple[tuple[Part, ...], ...]


def kinds(*rows: tuple) -> list[tuple[str, str, tuple[Part, ...]]]:
    return [(kind, label, parts_of(pattern)) for kind, label, pattern in rows]


def deck(*rows: tuple) -> list[tuple[str, str, Forms]]:
    """(kind, label, forms) of rows (kind, label, patterns or parts …)."""
    return [(kind, label, tuple(parts_of(f) if isinstance(f, str) else f for f in forms)) for kind, label, *forms in rows]


def routing_numbers(n: int) -> tuple[str, ...]:
    """Routing numbers whose check digit is right."""
    bodies = (f"{110_000_00 + 7919 * i:08}" for i in range(n))
    return tuple(b + str(-sum(w * int(d) for w, d in zip((3, 7, 1, 3, 7, 1, 3, 7), b)) % 10) for b in bodies)


_road = (Part(tuple(str(n) for n in range(1, 300)), "n"), lit(" "), Part(tuple(ROADS), "r"), lit(" Street"))
_place, _age = (Part(tuple(PLACES), "p"),), (Part(tuple(str(a) for a in range(90, 104)), "a"),)
_months, _days = ("{Month}", "{Mon}"), ("{dd}", "{do}")
#: (kind, label, forms) of the test deck; a value is of one of its kind's forms.
DECK = deck(
    ("date", "DATE", "{mm}/{dd}/{yyyy}", "{mm}-{dd}-{yy}", "{dd}.{mm}.{yyyy}", *(f"{m} {d}, {{yyyy}}" for m in _months for d in _days), "{dd} {Mon} {yyyy}", "{Month} {yyyy}"),
    ("dob", "DATE", "{mm}/{dd}/{yyyy}", "{dd} {Month} {yyyy}"),
    ("phone", "PHONE", "({d3}) 555-{d4}", "{d3}-555-{d4}", "{d3} 555 {d4}", "+1 {d3} 555 {d4}", "1-{d3}-555-{d4}", "({d3})555-{d4}"),
    ("email", "EMAIL", "{l6}.{l4}@mail.example.org", "{l5}{d2}@post.example.net"),
    ("address", "ADDRESS", _road, (*_road, lit(", Apt "), *parts_of("{d1}{L1}"))),
    ("city", "LOCATION", _place),
    ("zip", "ZIP", "{D1}{d4}"),
    ("mrn", "MRN", "{d8}", "{L2}{d6}"),
    ("org", "ORG", (*_place, lit(" Clinic")), (*_place, lit(" Partners"))),
    ("old_age", "AGE", _age),
    ("fax", "FAX", "{d3}-555-{d4}"),
    ("ssn", "SSN", "{D1}{d2}-{d2}-{d4}"),
    ("plan", "PLAN", "{L3}{d6}{L1}", "{d4}-{d4}"),
    ("account", "ACCOUNT", "{d10}"),
    ("accession", "ACCOUNT", "{L2}-{d2}-{d5}"),
    ("routing", "ACCOUNT", (Part(routing_numbers(40), "b"),)),
    ("claim", "ACCOUNT", "CLM{d7}"),
    ("license", "LICENSE", "{L1}{d7}"),
    ("passport", "LICENSE", "{L1}{d8}"),
    ("device", "DEVICE", "{L3}-{d6}"),
    ("employee", "ID", "E-{d5}"),
    ("docket", "ID", "{d1}:{d2}-cv-{d5}"),
    ("vin", "VEHICLE", "1{L2}{h2}{d5}{L1}{d6}"),
    ("plate", "VEHICLE", "{L3} {d4}"),
    ("url", "URL", "https://portal.example.org/{l8}"),
    ("ip", "IP", "10.{n}.{n}.{n}"),
)
#: The deck for training: other forms for the same labels.
TRAIN_DECK = [
    *kinds(("date", "DATE", "{yyyy}-{mm}-{dd}"), ("phone", "PHONE", "{d3}.555.{d4}"), ("mrn", "MRN", "M-{d6}"), ("zip", "ZIP", "{D1}{d4}-{d4}"), ("plan", "PLAN", "{d3}-{L2}-{d4}"), ("account", "ACCOUNT", "{d4} {d4} {d4}"), ("license", "LICENSE", "{L2}{d6}"), ("device", "DEVICE", "SN{d7}")),
    ("old_age", "AGE", _age),
]
PLATES = kinds(("plate", "VEHICLE", "{L2}-{d3}-{L2}"), ("vin", "VEHICLE", "2{L3}{h2}{d4}{L1}{d6}"))
SPOKEN = kinds(("phone", "PHONE", "{d1} {d1} {d1} 5 5 5 {d1} {d1} {d1} {d1}"), ("mrn", "MRN", "{d2} {d2} {d2} {d2}"), ("email", "EMAIL", "{l5} dot {l6} at example dot org"), ("date", "DATE", "{Month} {do} {yyyy}"), ("date", "DATE", "the {do} of {Month}"), ("date", "DATE", "{Month} the {do}"))
STYLES = [("letter", "a formal letter"), ("notes", "short notes"), ("email", "a thread of messages"), ("dictated", "a dictated memo"), ("chat", "a chat, in lower case"), ("form", "a form with labels"), ("narrative", "a story without labels"), ("ocr", "a scanned page")]
LENGTHS = ["3-5 sentences", "1-2 short paragraphs", "2-3 paragraphs"]
#: Clusters of the training spec with their weights in percent, and what each asks of the writer; the rest is mixed.
CLUSTERS = [("caps_name", 12), ("title_lf_name", 6), ("bare_name", 15), ("vehicle_weak", 10), ("zip_bare", 8), ("age90", 8), ("spoken", 9), ("hard_neg", 10), ("mixed", 22)]
HINTS = {
    "caps_name": "put {} into a heading, surname first and in capitals",
    "title_lf_name": "put {} into a heading, surname first",
    "bare_name": "use {} without any title or label near it",
    "vehicle_weak": "speak of {} only as something that was driven or parked",
    "zip_bare": "use {} without the words zip or postal",
    "age90": "give {} without the words age or years",
    "spoken": "copy {} letter for letter, as dictated",
}
EPONYMS = ["Alport", "Babinski", "Crohn", "Dupuytren", "Ehlers", "Fournier", "Guillain", "Hashimoto", "Kawasaki", "Marfan", "Raynaud", "Tourette"]


# --- parts in Catalyst and in SQL --------------------------------------------------------------------------------------


def literal(parts: tuple[Part, ...]) -> Column:
    """Parts as an array of structs: all choices in one string of equal widths."""
    widths = [max(map(len, p.choices)) for p in parts]
    return F.array(*[F.struct(F.lit("".join(c.ljust(w) for c in p.choices)).alias("text"), F.lit(w).alias("width"), F.lit(len(p.choices)).alias("n"), F.lit(any(len(c) < w for c in p.choices)).alias("pad"), F.lit(p.draw).alias("draw")) for p, w in zip(parts, widths, strict=True)])


def draw(n: int | Column, seed: Column, name: str | Column) -> Column:
    key = F.concat(seed, F.lit("|"), F.lit(name) if isinstance(name, str) else name)
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % n


def value_of(parts: Column, seed: Column) -> Column:
    """The string that parts make for a seed."""

    def chosen(p: Column) -> Column:
        text = F.substr(p["text"], (draw(p["n"], seed, p["draw"]) * p["width"]).cast("int") + 1, p["width"])
        return F.when(p["n"] == 1, p["text"]).when(p["pad"], F.rtrim(text)).otherwise(text)

    return F.array_join(F.transform(parts, chosen), "")


def value_sql(parts: tuple[Part, ...], seed: str) -> str:
    """value_of() as SQL text for DuckDB; seed is SQL text too."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "concat(" + ", ".join(quote(p.choices[0]) if len(p.choices) == 1 else pick_sql(list(p.choices), draw_sql(len(p.choices), seed, p.draw, False)) for p in parts) + ")"


def case(index: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), index.cast("int") + 1)


def case_sql(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


# --- specs of documents that a writer turns into prose ---------------------------------------------------------------

#: Slots of a test spec that hold names: (slot, role, number, chance in percent, forms).
NAME_SLOTS = [(0, "patient", 1, 100, ["full"]), (1, "patient", 1, 60, ["last"]), (2, "patient", 1, 20, ["first", "initial"]), (3, "relative", 2, 45, ["full", "last", "first"]), (4, "clinician", 3, 60, ["full", "last", "last_first"])]
FIRST_DECK, MOST_DECK, REPEATED = len(NAME_SLOTS), 12, 12


def plant_specs(ids: DataFrame, seed: int) -> DataFrame:
    """(doc_id, slot, ph, value, label, kind, role, count, mode, style, length): what each document of ids(doc_id) must hold.

    A document has 3 to 12 items: a patient in one to three forms, sometimes a relative and a clinician, and kinds of DECK in
    turn; an item comes twice in REPEATED of 100 cases.
    """
    s = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    has = [F.lit(True) if chance == 100 else draw(100, s, f"has{slot}") < chance for slot, _, _, chance, _ in NAME_SLOTS]
    names = reduce(lambda a, b: a + b, (h.cast("int") for h in has))
    style = draw(len(STYLES), s, "style")
    base = ids.select("doc_id", s.alias("s"), F.greatest(3 + draw(10, s, "target") - names, F.lit(0)).cast("int").alias("more"), case(style, [F.lit(m) for m, _ in STYLES]).alias("mode"), case(style, [F.lit(t) for _, t in STYLES]).alias("style"), case(draw(len(LENGTHS), s, "length"), [F.lit(x) for x in LENGTHS]).alias("length"), *[h.alias(f"has{k}") for k, h in enumerate(has)])

    def name(slot: int, role: str, number: int, forms: list[str]) -> Column:
        form = draw(len(forms), F.col("s"), f"form{slot}")
        value = case(form, [value_of(literal(FORMS[f]), F.concat(F.col("s"), F.lit(f"|{role}"))) for f in forms])
        return F.struct(F.lit(slot).alias("slot"), case(form, [F.lit(f"NAME_{number}{SUFFIX[f]}") for f in forms]).alias("ph"), value.alias("value"), F.lit("NAME").alias("label"), F.lit("name").alias("kind"), F.lit(role).alias("role"))

    deck = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(label).alias("label"), F.array(*[literal(p) for p in forms]).alias("forms")) for k, label, forms in DECK])

    def other(d: Column) -> Column:
        of = F.element_at(deck, ((F.col("doc_id") * 7 + d) % len(DECK)).cast("int") + 1)
        return F.struct((d + FIRST_DECK).alias("slot"), F.concat(of["label"], F.lit("_"), (d + FIRST_DECK).cast("string")).alias("ph"), value_of(F.element_at(of["forms"], (draw(F.size(of["forms"]), F.concat(F.col("s"), F.lit("|"), d.cast("string")), "of")).cast("int") + 1), F.concat(F.col("s"), F.lit("|"), d.cast("string"))).alias("value"), of["label"].alias("label"), of["kind"].alias("kind"), of["kind"].alias("role"))

    given = F.array_compact(F.array(*[F.when(F.col(f"has{k}"), name(slot, role, number, forms)) for k, (slot, role, number, _, forms) in enumerate(NAME_SLOTS)]))
    rest = F.when(F.col("more") > 0, F.transform(F.sequence(F.lit(0), F.col("more") - 1), other)).otherwise(F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), other), 1, 0))
    # An inner inline is optimised to test the size of the items first, for which all would be made a second time.
    rows = base.select("doc_id", "s", "mode", "style", "length", F.inline_outer(F.concat(given, rest))).where("slot IS NOT NULL")
    twice = draw(100, F.concat(F.col("s"), F.lit("|"), F.col("slot").cast("string")), "twice") < REPEATED
    return rows.select("doc_id", "slot", "ph", "value", "label", "kind", "role", F.when(twice & (F.length("value") >= 4), 2).otherwise(1).alias("count"), "mode", "style", "length")


def plant_specs_sql(ids: str, seed: int) -> str:
    """plant_specs() as SQL text for DuckDB; ids is SQL that gives doc_id."""
    s = f"concat('{seed}:', CAST(doc_id AS VARCHAR))"
    hit = lambda slot, chance: "true" if chance == 100 else f"{draw_sql(100, s, f'has{slot}', False)} < {chance}"
    names = " + ".join(f"({hit(slot, chance)})::INT" for slot, _, _, chance, _ in NAME_SLOTS)
    rows = []
    for slot, role, number, chance, forms in NAME_SLOTS:
        form, own = draw_sql(len(forms), s, f"form{slot}", False), f"concat({s}, '|{role}')"
        value = case_sql(form, [value_sql(FORMS[f], own) for f in forms])
        rows.append(f"SELECT doc_id, {slot} AS slot, {case_sql(form, [f"'NAME_{number}{SUFFIX[f]}'" for f in forms])} AS ph, {value} AS value, 'NAME' AS label, 'name' AS kind, '{role}' AS role FROM docs WHERE {hit(slot, chance)}")
    turn, own = f"((doc_id * 7 + d) % {len(DECK)})", f"concat({s}, '|', CAST(d AS VARCHAR))"
    label, kind = case_sql(turn, [f"'{x}'" for _, x, _ in DECK]), case_sql(turn, [f"'{k}'" for k, _, _ in DECK])
    rows.append(f"SELECT doc_id, (d + {FIRST_DECK})::INT AS slot, {label} || '_' || CAST(d + {FIRST_DECK} AS VARCHAR) AS ph, {case_sql(turn, [case_sql(draw_sql(len(forms), own, 'of', False), [value_sql(p, own) for p in forms]) for *_, forms in DECK])} AS value, {label} AS label, {kind} AS kind, {kind} AS role FROM docs, range(0, {MOST_DECK}) r(d) WHERE d < 3 + {draw_sql(10, s, 'target', False)} - ({names})")
    style = draw_sql(len(STYLES), s, "style", False)
    twice = draw_sql(100, f"concat({s}, '|', CAST(slot AS VARCHAR))", "twice", False)
    return f"WITH docs AS ({ids}), items AS ({' UNION ALL '.join(rows)}) SELECT *, CASE WHEN {twice} < {REPEATED} AND length(value) >= 4 THEN 2 ELSE 1 END AS count, {case_sql(style, [f"'{m}'" for m, _ in STYLES])} AS mode, {case_sql(style, [f"'{t}'" for _, t in STYLES])} AS style, {case_sql(draw_sql(len(LENGTHS), s, 'length', False), [f"'{x}'" for x in LENGTHS])} AS length FROM items"


def cluster_of(s: Column) -> Column:
    x, at, out = draw(100, s, "cluster"), 0, F.lit(CLUSTERS[-1][0])
    for name, weight in reversed(CLUSTERS[:-1]):
        at = sum(w for _, w in CLUSTERS[: [c for c, _ in CLUSTERS].index(name) + 1])
        out = F.when(x < at, name).otherwise(out)
    return out


def cluster_sql(s: str) -> str:
    x, at, out = draw_sql(100, s, "cluster", False), 0, []
    for name, weight in CLUSTERS[:-1]:
        at += weight
        out.append(f"WHEN {x} < {at} THEN '{name}'")
    return "CASE " + " ".join(out) + f" ELSE '{CLUSTERS[-1][0]}' END"


#: What stands first in a document of each cluster: (label, kind, choices of parts).
LEADS: dict[str, list[tuple[str, str, tuple[Part, ...]]]] = {
    "caps_name": [("NAME", "name", FORMS["last_first"])],
    "title_lf_name": [("NAME", "name", FORMS["last_first_title"])],
    "bare_name": [("NAME", "name", FORMS[f]) for f in ("first", "last", "full")],
    "vehicle_weak": [(label, kind, p) for kind, label, p in PLATES],
    "zip_bare": [(label, kind, p) for kind, label, p in TRAIN_DECK if kind == "zip"],
    "age90": [(label, kind, p) for kind, label, p in TRAIN_DECK if kind == "old_age"],
    "spoken": [(label, kind, p) for kind, label, p in SPOKEN],
    "mixed": [("NAME", "name", FORMS["full"])],
}


def train_specs(ids: DataFrame, seed: int) -> DataFrame:
    """(doc_id, cluster, slot, ph, value, label, kind, hint): a training spec of weighted clusters.

    A cluster's first item is of its own kind, with a hint for the writer; 2 to 11 of the training deck follow, spoken ones in
    the spoken cluster. Documents of hard_neg hold no identifier but 4 to 7 eponyms, as items without a label.
    """
    s = F.concat(F.lit(f"train:{seed}:"), F.col("doc_id").cast("string"))
    x = ids.select("doc_id", s.alias("s"), cluster_of(s).alias("cluster"), (2 + draw(10, s, "more")).cast("int").alias("more"), (4 + draw(4, s, "eponyms")).cast("int").alias("n_eponyms"))

    def one(of: list[tuple[str, str, tuple[Part, ...]]]) -> Column:
        return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), literal(p).alias("parts")) for label, kind, p in of])

    leads = F.create_map(*[y for c, of in LEADS.items() for y in (F.lit(c), one(of))])
    decks = F.create_map(F.lit(False), one([(label, kind, p) for kind, label, p in TRAIN_DECK]), F.lit(True), one([(label, kind, p) for kind, label, p in SPOKEN]))
    empty = F.lit(None).cast("string")

    def item(slot: Column, of: Column) -> Column:
        return F.struct(slot.alias("slot"), F.concat(of["label"], F.lit("_"), slot.cast("string")).alias("ph"), value_of(of["parts"], F.concat(F.col("s"), F.lit("|"), slot.cast("string"))).alias("value"), of["label"].alias("label"), of["kind"].alias("kind"))

    def lead() -> Column:
        of = F.element_at(leads, F.col("cluster"))
        return item(F.lit(0), F.element_at(of, (draw(1 << 20, F.col("s"), "lead") % F.size(of)).cast("int") + 1))

    def more(j: Column) -> Column:
        of = F.element_at(decks, F.col("cluster") == "spoken")
        return item(j, F.element_at(of, ((F.col("doc_id") * 5 + j) % F.size(of)).cast("int") + 1))

    def eponym(j: Column) -> Column:
        at = (draw(len(EPONYMS), F.col("s"), "eponym") + j * 5) % len(EPONYMS)
        return F.struct(j.cast("int").alias("slot"), empty.alias("ph"), case(at, [F.lit(e) for e in EPONYMS]).alias("value"), empty.alias("label"), F.lit("eponym").alias("kind"))

    planted = F.concat(F.array(lead()), F.transform(F.sequence(F.lit(1), F.col("more")), more))
    rows = x.select("doc_id", "cluster", F.inline(F.when(F.col("cluster") == "hard_neg", F.transform(F.sequence(F.lit(0), F.col("n_eponyms") - 1), eponym)).otherwise(planted)))
    hint = F.element_at(F.create_map(*[F.lit(y) for kv in HINTS.items() for y in kv]), F.col("cluster"))
    return rows.withColumn("hint", F.when(F.col("slot") == 0, F.replace(hint, F.lit("{}"), F.concat(F.lit("[["), F.col("ph"), F.lit("]]")))))


def train_specs_sql(ids: str, seed: int) -> str:
    """train_specs() as SQL text for DuckDB."""
    s = f"concat('train:{seed}:', CAST(doc_id AS VARCHAR))"
    rows = []
    own = lambda slot: f"concat({s}, '|', CAST({slot} AS VARCHAR))"
    for cluster, of in LEADS.items():
        k = f"({draw_sql(1 << 20, s, 'lead', False)} % {len(of)})"
        label = case_sql(k, [f"'{x}'" for x, _, _ in of])
        rows.append(f"SELECT doc_id, cluster, 0 AS slot, {label} || '_0' AS ph, {case_sql(k, [value_sql(p, own(0)) for *_, p in of])} AS value, {label} AS label, {case_sql(k, [f"'{x}'" for _, x, _ in of])} AS kind FROM docs WHERE cluster = '{cluster}'")
    for spoken, deck in ((False, TRAIN_DECK), (True, SPOKEN)):
        k = f"((doc_id * 5 + j) % {len(deck)})"
        label = case_sql(k, [f"'{x}'" for _, x, _ in deck])
        rows.append(f"SELECT doc_id, cluster, j::INT AS slot, {label} || '_' || CAST(j AS VARCHAR) AS ph, {case_sql(k, [value_sql(p, own('j')) for *_, p in deck])} AS value, {label} AS label, {case_sql(k, [f"'{x}'" for x, _, _ in deck])} AS kind FROM docs, range(1, 12) r(j) WHERE cluster {'=' if spoken else 'NOT IN'} {"'spoken'" if spoken else "('spoken', 'hard_neg')"} AND j <= 2 + {draw_sql(10, s, 'more', False)}")
    at = f"(({draw_sql(len(EPONYMS), s, 'eponym', False)} + j * 5) % {len(EPONYMS)})"
    rows.append(f"SELECT doc_id, cluster, j::INT AS slot, NULL AS ph, {case_sql(at, [f"'{e}'" for e in EPONYMS])} AS value, NULL AS label, 'eponym' AS kind FROM docs, range(0, 7) r(j) WHERE cluster = 'hard_neg' AND j < 4 + {draw_sql(4, s, 'eponyms', False)}")
    hint = "CASE cluster " + " ".join(f"WHEN '{c}' THEN replace('{h}', '{{}}', '[[' || ph || ']]')" for c, h in HINTS.items()) + " END"
    return f"WITH docs AS (SELECT doc_id, {cluster_sql(s)} AS cluster FROM ({ids})), items AS ({' UNION ALL '.join(rows)}) SELECT *, CASE WHEN slot = 0 THEN {hint} END AS hint FROM items"


# --- whole notes from templates ----------------------------------------------------------------------------------------

#: Templates by domain; even ones are for universe A, odd ones for B. A slot is {kind}, or {kind!} where the words before it say what it is; P and P2 are persons, in a form.
TEMPLATES: dict[str, list[str]] = {
    "clinical": ["Patient {P:full} was seen on {date}; record {mrn!} is open. ", "{P:last} called from {phone} about the visit of {date}. ", "Her sister {P2:first} lives at {address} in {city}. ", "Chart of {P:last_first}, born {dob}, was sent to {email}. ", "The pump {device!} was checked; {P:initial} will return on {date}. ", "{P:full} is {old_age} and has plan {plan!} by now. "],
    "tax": ["Return of {P:full}, SSN {ssn!}, was filed on {date}. ", "Refund goes to account {account!} of {P:last}. ", "{P2:full} signed at {address} for {P:first}. ", "Letter to {P:initial} at {email} came back on {date}. "],
    "legal": ["Counsel for {P:full} filed the motion on {date}. ", "{P:last} was served at {address}, {city}, by {P2:full}. ", "Exhibit names {P:first} and the plate {plate!} as seen. ", "Call {P2:last} at {phone!} before {date}. "],
    "hr": ["{P:full} starts on {date}; mail {email} for access. ", "{P:first} moved to the office in {city} after {date}. ", "Review of {P:last} by {P2:initial} is due on {date}. ", "Deposit to account {account!} was changed by {P:full}. "],
}
#: Sentences without identifiers, many of which look as if they had some; even ones for A, odd ones for B.
FILLERS: dict[str, list[str]] = {
    "clinical": ["Strength was 4/5 on the left, pain 6/10. ", "BP 132/82, HR 70, no fever. ", "Took 500 mg twice a day. ", "Signs of Parkinson disease were absent. "],
    "tax": ["Schedule C shows a loss. ", "Form 8829 was not needed. ", "Four payments of 1,250 were made. ", "The deduction under section 179 was taken. "],
    "legal": ["The motion under Rule 12(b)(6) was denied. ", "See 42 U.S.C. 1983 for the standard. ", "Exhibit 14 was admitted. ", "Discovery closes in 90 days. "],
    "hr": ["Rating was 4 of 5. ", "The balance is 12.5 days. ", "Two weeks of notice apply. ", "The Blue plan has a deductible of 500. "],
}
MODES = ["written"] * 6 + ["dictated"] * 2 + ["ocr", "chat"]
SLOT = r"\{(\w+)(?::(\w+))?(!)?\}"
MOST_LINES, FILLED, MISREAD = 5, 60, 35


@dataclass(frozen=True)
class Piece:
    """A piece of a template: parts, whose draws are a person's or the line's; an identifier has a label and tags."""

    parts: tuple[Part, ...]
    seed: str = "line"
    label: str | None = None
    tags: tuple[str, ...] = ()
    spoken: tuple[Part, ...] | None = None


def pieces_of_template(template: str) -> list[Piece]:
    import re

    by_kind = {k: (label, forms[0]) for k, label, forms in DECK}
    said = {k: p for k, _, p in SPOKEN}
    out, at = [], 0
    for m in re.finditer(SLOT, template):
        if m.start() > at:
            out.append(Piece((lit(template[at : m.start()]),)))
        slot, form, cued = m.groups()
        cue = "cue" if cued else "no_cue"
        if slot in ("P", "P2"):
            out.append(Piece(FORMS[form], slot, "NAME", (cue, *(["relative"] if slot == "P2" else []))))
        else:
            label, parts = by_kind[slot]
            out.append(Piece(parts, "line", label, (cue,), said.get(slot)))
        at = m.end()
    return [*out, Piece((lit(template[at:]),))] if at < len(template) else out


def lines_of(domain: str, universe: str) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Templates and fillers of a universe, as pieces."""
    odd = "AB".index(universe)
    mine = [pieces_of_template(t) for i, t in enumerate(TEMPLATES[domain]) if i % 2 == odd]
    return mine, [[Piece((lit(t),))] for i, t in enumerate(FILLERS[domain]) if i % 2 == odd]


@dataclass(frozen=True)
class Drawn:
    """A piece ready to be written: its parts as (key of the draw, number of choices, choices), a single string without key."""

    parts: list[tuple[bytes | None, int, tuple[str, ...]]]
    spoken: list[tuple[bytes | None, int, tuple[str, ...]]]
    person: bytes | None
    label: str | None
    tags: tuple[str, ...]


def ready(p: Piece) -> Drawn:
    bare = lambda parts: [(f"|{x.draw}".encode() if len(x.choices) > 1 else None, len(x.choices), x.choices) for x in parts]
    return Drawn(bare(p.parts), bare(p.spoken or p.parts), None if p.seed == "line" else f"|{p.seed}".encode(), p.label, p.tags)


def number(key: bytes) -> int:
    """What draw() takes the remainder of."""
    return int.from_bytes(sha256(key).digest()[:4])


def note_of(s: bytes, mine: list[list[Drawn]], fill: list[list[Drawn]]) -> tuple[str, str, list[tuple[int, int, str, tuple[str, ...]]]]:
    """(mode, text, spans) of the note with that seed: a span starts where the pieces before it end."""
    mode, out, spans, at = MODES[number(s + b"|mode") % len(MODES)], [], [], 0
    dictated, chat, scanned = mode == "dictated", mode == "chat", mode == "ocr"
    for j in range(2 + number(s + b"|lines") % (MOST_LINES - 1)):
        own = b"%b|%d" % (s, j)
        line = mine[number(own + b"|template") % len(mine)]
        if number(own + b"|filled") % 100 < FILLED:
            line = line + fill[number(own + b"|filler") % len(fill)]
        for k, p in enumerate(line):
            if p.label is None:
                value = p.parts[0][2][0]
            else:
                key = b"%b|%d" % (own, k)
                value = valued(p.spoken if dictated else p.parts, s + p.person if p.person else key)
                if scanned and "0" in value and number(key + b"|ocr") % 100 < MISREAD:
                    value = value.replace("0", "O", 1)
                spans.append((at, at + len(value), p.label, p.tags))
            out.append(value)
            at += len(value)
    text = "".join(out)
    return mode, text.lower() if chat else text, spans


def valued(parts: list[tuple[bytes | None, int, tuple[str, ...]]], seed: bytes) -> str:
    return "".join([c[number(seed + k) % n] if k else c[0] for k, n, c in parts])


def template_notes(ids: DataFrame, domain: str, universe: str, seed: int) -> DataFrame:
    """(doc_id, domain, mode, universe, text, spans) of notes: 2 to MOST_LINES template lines, each followed by a filler in
    FILLED of 100 cases; spans hold by construction, with the tags of their slots. Chats are in lower case; of what is scanned,
    MISREAD of 100 identifiers with a 0 have it read as O."""
    return notes_by_kind(ids, [(domain, universe)], seed)


def notes_by_kind(ids: DataFrame, kinds: list[tuple[str, str]], seed: int, spans: bool = True) -> DataFrame:
    """template_notes() of each (domain, universe), from one pass over ids(doc_id); the spans may be left out.

    An Arrow stage: a note is some sixty hashes, which cost less there than as higher-order functions, and no kind is planned or
    read for itself.
    """
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("tags", pa.list_(pa.string()))]))
    lines = {(d, u): [[list(map(ready, line)) for line in of] for of in lines_of(d, u)] for d, u in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).to_pylist()
            for (domain, universe), (mine, fill) in lines.items():
                s = f"{universe}:{domain}:{seed}:"
                made = [(None, None, None) if n is None else note_of((s + n).encode(), mine, fill) for n in names]
                same = lambda x: pa.array([x] * len(names), pa.string())  # noqa: E731, B023
                columns = [b.column(0), same(domain), pa.array([m for m, _, _ in made], pa.string()), same(universe), pa.array([t for _, t, _ in made], pa.string())]
                if spans:
                    columns.append(pa.array([None if x is None else [{"start": i, "end": e, "label": label, "tags": tags} for i, e, label, tags in x] for _, _, x in made], shape))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "domain", "mode", "universe", "text", "spans"][: len(columns)])

    ddl = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, domain string, mode string, universe string, text string"
    more = ", spans array<struct<start: int, end: int, label: string, tags: array<string>>>" if spans else ""
    return ids.select("doc_id", F.col("doc_id").cast("string").alias("name")).mapInArrow(run, ddl + more)


def template_notes_sql(ids: str, domain: str, universe: str, seed: int) -> str:
    """Pieces (doc_id, mode, j, k, value, label, tags) of template_notes() as SQL text for DuckDB, in order of j and k."""
    s = f"concat('{universe}:{domain}:{seed}:', CAST(doc_id AS VARCHAR))"
    mine, fill = lines_of(domain, universe)
    own = f"concat({s}, '|', CAST(j AS VARCHAR))"
    rows = []
    for t, line in enumerate(mine):
        for after in (None, *range(len(fill))):
            for k, p in enumerate([*line, *(fill[after] if after is not None else [])]):
                if after is not None and k < len(line):
                    continue
                at = f"concat({s}, '|', CAST(j AS VARCHAR), '|{k}')" if p.seed == "line" else f"concat({s}, '|{p.seed}')"
                value = value_sql(p.parts, at)
                if p.spoken:
                    value = f"CASE WHEN mode = 'dictated' THEN {value_sql(p.spoken, at)} ELSE {value} END"
                misread = f"{draw_sql(100, f"concat({s}, '|', CAST(j AS VARCHAR), '|{k}')", 'ocr', False)} < 35"
                shown = f"CASE WHEN mode = 'chat' THEN lower({value})" + (f" WHEN mode = 'ocr' AND {misread} THEN regexp_replace({value}, '^([^0]*)0', '\\1O')" if p.label else "") + f" ELSE {value} END"
                when = f"template = {t}" + (f" AND filler = {after}" if after is not None else "")
                rows.append(f"SELECT doc_id, mode, j, {k} AS k, {shown} AS value, {'NULL' if p.label is None else repr(p.label)} AS label, '{','.join(p.tags)}' AS tags FROM lines WHERE {when}")
    filled = f"CASE WHEN {draw_sql(100, own, 'filled', False)} < {FILLED} THEN {draw_sql(len(fill), own, 'filler', False)} END"
    return f"docs AS (SELECT doc_id, {case_sql(draw_sql(len(MODES), s, 'mode', False), [repr(m) for m in MODES])} AS mode, 2 + {draw_sql(MOST_LINES - 1, s, 'lines', False)} AS n FROM ({ids})), lines AS (SELECT doc_id, mode, j, {draw_sql(len(mine), own, 'template', False)} AS template, {filled} AS filler FROM docs, range(0, {MOST_LINES}) r(j) WHERE j < n), pieces AS ({' UNION ALL '.join(rows)})"


def coverage(items: DataFrame, *columns: str) -> DataFrame:
    """How many items of a spec there are for each value of each column: (by, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in columns])
    return items.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("by", "value").agg(F.count("*").alias("n"))


def document_ids(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "doc_id")
