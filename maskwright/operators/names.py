"""Shapes of person names, and checks that tell them from clinical and everyday words.

A candidate is read as a sequence of token classes, and a pattern over the classes decides: which tokens are particles,
initials, suffixes, plain words or stop words is told by the tables below, by the endings of technical terms, and by a list
that a run may bring along (`load_stop_words`, `Config.stop_words`).
"""

from __future__ import annotations

import re

# Patterns of name tokens, particles and whole names.
NTOK = r"(?:(?:Mc|Mac|O['’]|D['’])[A-Z][a-z]+(?:-[A-Z][a-z]+)*|[A-Z][a-z]+(?:['’-][A-Z]?[a-z]+)*|[A-Z]{2,})"
PART = r"(?:de|De|la|La|van|Van|von|Von|del|Del|der|den|di|Di|da|Da|le|Le|bin|ibn|al|Al|el|El|St\.)"
CTOK = r"[A-Z]+(?:[-'’][A-Z]+)*"
FULL = rf"(?:[A-Z]\.\s+)?(?:{PART}\s+){{0,2}}{NTOK}(?:\s+[A-Z]\.)?(?:\s+(?:{PART}\s+){{0,2}}{NTOK}){{0,2}}"
PAIR = rf"(?:{CTOK}(?:\s+{CTOK}){{0,2}}|{FULL}),\s*{NTOK}(?:\s+[A-Z]\b\.?)?"
REGISTERED = r"[A-Z]{2,}(?:[-'][A-Z]+)?,\s+[A-Z]{2,}(?:\s+[A-Z]\.?)?"

# Words inside surnames; after given names; surnames and given names that are words; words after a name's label; words never propagated.
PARTICLES = frozenset("de del dela der den di da le la las los van von bin ibn al el st san santa ten ter vander vanden du des het op zu zum zur af av dos das do".split())
NAME_SUFFIX = frozenset("jr sr ii iii iv v vi md do rn np pa phd dmd dds dpm od esq msw lcsw lmft pt ot dpt mba mph msn bsn mbbs frcpc facp facs facog faap faan cna lpn lvn ma ms ba bs pharmd rd cdn crt rrt emt cma cpnp fnp".split())
LEFT_OK = frozenset("day week weeks key keys good best field fields page pages long little low new case summer winter dawn morning noon sunrise sunset".split())
RIGHT_OK = frozenset("will summer dawn morning page day".split())
NAME_STOP = frozenset("date dob age sex gender mrn id phone tel fax email address male female is was has had will who the and with on at in for of to presents presented reports reported denies states md do rn np pa phd room bed unit ward dept department admitted discharged seen history allergies medications diagnosis visit chief complaint hpi pmh ros note notes none unknown n/a na yes no not self same see per status insurance ssn account medical record number hospital clinic center centre health care dr mr mrs ms miss mx prof he she they her his their called said came lives also but then when after before".split())
COMMON = frozenset("may will mark rose grace hope faith joy white black brown green gray grey young long short little small best good bell graves paget down downs marks bill art pat sue rob jack wells burns payne pain strong weeks day days love price rich banks fields woods stone cross king page cook hand head foot june april august summer winter north south east west christian frank miles hunter chase lane hill ford case parks moody savage patient doctor nurse the and for von van del der los las".split())

#: Clinical words are told by rule: endings of clinical terms, and the headings and everyday words below. A longer list may be added to EXTRA_STOP.
CLINICAL_ENDINGS = ("itis", "osis", "emia", "aemia", "ectomy", "otomy", "ostomy", "plasty", "pathy", "ology", "ologist", "graphy", "gram", "scopy", "algia", "uria", "oma", "penia", "phagia", "plegia", "pnea", "rrhea", "megaly", "trophy", "tension", "cillin", "mycin", "statin", "pril", "sartan", "olol", "azole", "tidine", "prazole", "idine", "mab", "tion", "sion", "ment", "ness", "ity", "ings", "ing", "ical", "ular", "ous", "ive", "able", "ible")
CLINICAL = frozenset("acute alert allergies and appendix arm arms arrest aspirin asthma back bacteria bed bedside bilateral blood body bone bowel brain breast breath call cancer cardiac care cell chest chills chronic clear clinic clots cold colon constipation consult cough cramps culture daily death diabetes diarrhea diet discharge dizzy dose drain drug ear edema exam eye eyes failure fall falls fatigue female fever finger focal foot fracture gait gland glucose groin hand head heart heat heel hip history home hospital hives ice infarct influenza injury insulin intact iron itch joint kidney knee labs lactate leg legs lesion liver loss lower lump lung lungs male mass meds mild moderate mouth muscle nausea neck nerve node normal nose notes oral organ pain palms patient pelvis plan platelets potassium pulse rash rate rectal renal rest rib right sepsis severe shock shoulder sinus skin sleep sodium soft spine stable stool stroke surgery swab sweats swelling thigh throat thyroid tissue toe tongue trauma tremor tumor ulcer upper urine uterus vein vision vital vitals vomit wheeze wound wrist".split())
HEADINGS = frozenset("addendum admission agreement allergies anesthesia appointment approval assessment attending authorization background billing care chart chemistry clinic complaint conclusion condition conditions consent consultation contact coverage current dental department diagnoses diagnosis disease disorder disposition education emergency emergent encounter evaluation exam examination exercise exhibit family findings followup form general goals guidelines hospital impression indications inpatient instructions intake interim interval laboratory management medical medication medications nursing objective onset operative order orders outpatient past pathology physical physician plan present primary prior problem procedure procedures progress provider psychiatric radiology reason recommendations referral rehab results return review risk routine rounds schedule screening section service services signature signs social specimen stage status subjective summary supplies surgical symptoms systems table technique test tests therapy times total treatment triage urgent vaccines visit vitals ward warning".split())
EVERYDAY = frozenset("about above after again all also any are before below between both but can did does done each either else every few first for from further hereby herein here how however into its just last less many more most much must neither never next none nor not now off once only other otherwise our over page part prior second several shall should since some such than that their them then there therefore these they third this those through thus too under until upon very was were what when where whereas whether which while who whole whom whose why will within without yes yet you your".split())
MACHINES = frozenset("api ascii avi bmp cpu csv css delete dns doc docx eps error exe failed false fatal ftp get gif gpu head html http https info input ios ipv jpeg jpg json kill linux log mac mime mpeg null option options output patch pdf php png post ppt put ram rom rtf select sql ssh svg tcp tiff true txt udp unix update uri url usb utf wav webp xls xlsx xml yaml zip".split())
FIRMS = frozenset("and associates bank bros bureau company consulting corp corporation council court foundation fund gmbh group holdings inc incorporated insurance international limited llc llp ltd ministry partners plc society trust university".split())
GEO = frozenset("alabama alaska arizona arkansas california colorado connecticut delaware florida hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont wisconsin wyoming ontario quebec manitoba saskatchewan alberta canada mexico england france germany spain italy china japan india brazil russia ireland scotland wales poland sweden norway denmark finland greece turkey egypt israel iran iraq korea vietnam thailand philippines indonesia australia austria belgium netherlands switzerland portugal argentina chile colombia peru cuba usa uk uae boston chicago toronto ottawa montreal vancouver seattle denver dallas houston atlanta miami portland phoenix philadelphia detroit baltimore cleveland pittsburgh london paris berlin madrid rome tokyo beijing moscow sydney".split())
#: More stop words, of the run at hand.
EXTRA_STOP: frozenset[str] = frozenset()
STOP = NAME_STOP | CLINICAL | HEADINGS | EVERYDAY | MACHINES | FIRMS


def load_stop_words(path: str) -> frozenset[str]:
    """Stop words of a file, one or more on a line, for Config.stop_words."""
    with open(path, encoding="utf-8") as f:
        return frozenset(f.read().lower().split())


def is_stop(word: str) -> bool:
    return word in STOP or word in EXTRA_STOP or (len(word) > 4 and word.endswith(CLINICAL_ENDINGS))


def shaped(token: str) -> bool:
    return all(c.isalpha() or c in "-'’" for c in token)


#: Of each side of "LAST, FIRST", words that may be names though they are stop words, and the classes of its tokens in order:
#: p particle, w word, i initial, s suffix; x is anything else.
SIDES = {"last": (LEFT_OK, re.compile("[pw]{1,4}")), "first": (RIGHT_OK, re.compile("w{1,2}i?s*"))}


def class_of(token: str, side: str) -> str:
    bare = token.rstrip(".")
    word, first = bare.lower(), side == "first"
    if first and word in NAME_SUFFIX:
        return "s"
    if first and len(bare) == 1 and bare.isupper():
        return "i"
    if not first and word in PARTICLES:
        return "p"
    known = is_stop(word) and word not in SIDES[side][0]
    return "w" if shaped(token) and sum(map(str.isalpha, word)) >= 3 and not known and not (first and word in GEO) else "x"


def side_is_name(tokens: list[str], side: str) -> bool:
    return SIDES[side][1].fullmatch("".join(class_of(t, side) for t in tokens)) is not None


def name_pair(value: str) -> bool:
    """Whether "LAST, FIRST" looks like a name on both sides."""
    left, comma, right = value.partition(",")
    return bool(comma) and side_is_name(left.split(), "last") and side_is_name(right.split(), "first")


def name_or_pair(value: str) -> bool:
    if "," in value:
        return name_pair(value)
    first = next(iter(value.split()), "").rstrip(".")
    return bool(first) and shaped(first) and not is_stop(first.lower())


TOKEN = re.compile(r"[^ \t\r\n\f\v,]+")


def trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A name's span without label words at its end, and without one at its start; None if nothing stays."""
    tokens = [m for m in TOKEN.finditer(text, start, end)]
    label = [m[0].lower().strip(".") in NAME_STOP for m in tokens]
    last = next((i for i in range(len(tokens) - 1, 0, -1) if not label[i]), 0)
    kept = tokens[1 if label and label[0] else 0 : last + 1]
    return (kept[0].start(), kept[-1].end()) if kept else None
