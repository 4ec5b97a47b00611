"""The table of structured-identifier rules.

A rule is a pattern with a category, the group that is the identifier, a confidence, a check of its value, and a guard: a
cheap necessary condition on the document (digits, a cue word, a sign) without which the pattern isn't tried.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import validators as v
from . import names
from .starts import capital, prefixes, wanted

# Building blocks of the patterns.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
STREET = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl|Circle|Cir|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Trail|Trl|Square|Sq|Crescent|Cres|Close|Row|Alley)"
STATE = r"(?:AL|AK|AZ|AR|CA|CO|CT|DE|DC|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|PR)"
PROVINCE = r"(?:ON|QC|BC|AB|MB|SK|NS|NB|NL|PE|YT|NT|NU)"
IDVAL = r"([A-Za-z0-9][A-Za-z0-9-]{3,23})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MON_DAY = r"(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])"
YEAR, DAY = r"(?:19|20)\d{2}", r"\d{1,2}(?:st|nd|rd|th)?"
SPOKEN = r"(\d{1,4}(?:[ -]\d{1,4}){2,11}(?:[ -](?-i:[A-Z]{1,3})\b)?)"
ORDINAL = r"(?:thirty[- ]first|thirtieth|twenty[- ](?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth)|twentieth|nineteenth|eighteenth|seventeenth|sixteenth|fifteenth|fourteenth|thirteenth|twelfth|eleventh|tenth|ninth|eighth|seventh|sixth|fifth|fourth|third|second|first)"
NUM = r"(?:number|no\.?|#)"
NUM_OR_ID = r"(?:id|number|no\.?|#)"
WITH_NUM = rf"(?:\s*{NUM})?"
TO_VALUE = r"\s*[:#]?\s*#?"
SAID = r"\s*(?:is|was|of)?\s*[:#]?\s*"
PLAN_CUES = r"(?:member(?:ship)?|policy|subscriber|group|insurance|beneficiary|medicare|medicaid|plan|health(?:\s*card)?|ohip|nhs)"
NANP = r"(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}"
ONE = r"(?:\+?1[\s.-]?)?"
NUMERIC_DATE = rf"(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|{YEAR}-\d{{2}}-\d{{2}})"
NAMED_DATE = rf"(?:{MONTH}\.?\s+{DAY},?\s+{YEAR}|{DAY}[\s-]+{MONTH}\.?,?[\s-]+{YEAR})"


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    pattern: str
    group: int = 0
    confidence: float = 1.0
    check: Callable[[str], bool] | None = None
    dob: bool = False
    digits: int = 0  #: digits that the text must hold at least
    needs: tuple[str, ...] = ()  #: one of these must stand in the lower-cased text
    also: tuple[str, ...] = ()  #: and one of these
    cased: tuple[str, ...] = ()  #: one of these must stand in the text as it is
    capitals: bool = False  #: two capitals must stand together, or with a hyphen or apostrophe between them
    regex: re.Pattern = field(init=False, repr=False, compare=False)
    heads: frozenset[str] | None = field(init=False, repr=False, compare=False)  #: first letters of all matches, if known
    spot: int | None = field(init=False, repr=False, compare=False)  #: where an index keeps the places of words that begin so

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern))
        object.__setattr__(self, "heads", prefixes(self.pattern))
        object.__setattr__(self, "spot", None if self.heads is None else wanted(self.heads, capital(self.pattern)))

    def may_match(self, text: str, low: str, n_digits: int, has_capitals: bool) -> bool:
        if n_digits < self.digits or (self.capitals and not has_capitals):
            return False
        for keys, where in ((self.needs, low), (self.also, low), (self.cased, text)):
            for k in keys:
                if k in where:
                    break
            else:
                if keys:
                    return False
        return True


def cued(name: str, category: str, cues: str, value: str, confidence: float = 1.0, check=None, digits: int = 1, needs: str = "", between: str = TO_VALUE) -> Rule:
    """A rule whose value follows one of some cues, in any case."""
    return Rule(name, category, rf"(?i)\b(?:{cues}){between}{value}", 1, confidence, check, digits=digits, needs=tuple(needs.split()))


CAPITALS = re.compile("[A-Z][-'’]?[A-Z]")
ORDINALS_LOW = tuple("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth teenth tieth".split())
MONTHS_LOW = tuple("jan feb mar apr may jun jul aug sep oct nov dec".split())

#: The rules; their order decides between equal ranks.
RULES: list[Rule] = [
    Rule("email", "EMAIL", r"(?i)\b[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b", needs=("@",)),
    Rule("url", "URL", r"""(?i)\b(?:https?://|www\.)[^\s<>"'\])]+[^\s<>"'\]).,;:!?]""", needs=("://", "www.")),
    Rule("ipv4", "IP", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", confidence=0.9, digits=4, needs=(".",)),
    Rule("ipv6", "IP", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b", confidence=0.95, needs=(":",)),
    Rule("ipv6_short", "IP", r"(?i)(?:\b[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})\b", confidence=0.8, needs=("::",)),
    Rule("mac", "DEVICE", r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b", confidence=0.95, needs=(":", "-")),
    cued("fax", "FAX", rf"fax{WITH_NUM}", rf"({ONE}{NANP})\b", digits=10, needs="fax", between=r"\s*[:#]?\s*"),
    Rule("phone", "PHONE", ONE + r"(?:\(\d{3}\)\s?|\b\d{3}[\s.-])\d{3}[\s.-]\d{4}\b(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?", confidence=0.95, check=v.not_all_same, digits=10),
    Rule("phone_international", "PHONE", r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}\b", confidence=0.9, check=v.not_all_same, digits=6, needs=("+",)),
    cued("phone_cued", "PHONE", rf"(?:phone|tel|telephone|cell|mobile|pager|call(?:back)?|contact){WITH_NUM}", r"(\d{3}[\s.-]?\d{4}|\d{10})\b", 0.85, digits=7, needs="phone tel cell mobile pager call contact", between=r"\s*[:#]?\s*"),
    Rule("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", confidence=0.97, check=v.valid_ssn, digits=9),
    cued("ssn_cued", "SSN", rf"ssn|ss#|social security{WITH_NUM}", r"(\d{3}[- ]?\d{2}[- ]?\d{4}|(?:[x*]{3}[- ]?[x*]{2}[- ]?)\d{4})\b", digits=4, needs="ss social", between=r"\s*[:#]?\s*"),
    cued("mrn", "MRN", rf"mrn|medical record{WITH_NUM}|med\.?\s?rec\.?{WITH_NUM}|patient\s?id|pt\.?\s?id|chart(?:\s*{NUM})|unit\s*{NUM}|hospital\s*{NUM}", IDVAL, check=v.at_least(3), digits=3, needs="mrn med patient pt chart unit hospital"),
    cued("plan", "PLAN", rf"{PLAN_CUES}\s*{NUM_OR_ID}|mbi|hicn|hcn|ohip|health\s*card", IDVAL, check=v.at_least(3), digits=3, needs="member policy subscriber group insurance beneficiary medica plan health ohip nhs mbi hicn hcn"),
    cued("account", "ACCOUNT", rf"(?:account|acct\.?|invoice|claim|encounter|visit|accession|order|case|reference|ref\.?|confirmation|billing|specimen|requisition|csn|fin)\s*{NUM_OR_ID}?", IDVAL, 0.9, v.at_least(4), 4, "acc invoice claim encounter visit order case ref confirmation billing specimen requisition csn fin"),
    Rule("card", "ACCOUNT", r"\b\d(?:[ -]?\d){12,18}\b", confidence=0.95, check=v.luhn, digits=13),
    cued("license", "LICENSE", rf"driver'?s?\s*licen[sc]e|d\.?l\.?\s*{NUM}|licen[sc]e\s*{NUM}|dea{WITH_NUM}|npi{WITH_NUM}|passport{WITH_NUM}|certificate\s*{NUM}", IDVAL, check=v.at_least(3), digits=3, needs="licen d dea npi passport certificate"),
    Rule("vin", "VEHICLE", r"\b[A-HJ-NPR-Z0-9]{17}\b", confidence=0.95, check=v.valid_vin, digits=3),
    cued("vin_cued", "VEHICLE", "vin", r"([A-HJ-NPR-Z0-9]{17})\b", digits=0, needs="vin", between=r"\s*[:#]?\s*"),
    cued("plate", "VEHICLE", rf"licen[sc]e plate|plate{WITH_NUM}|tag\s*{NUM}", r"([A-Z0-9][A-Z0-9 -]{2,8}[A-Z0-9])\b", 0.9, v.at_least(1), 1, "plate tag", r"\s*[:#]?\s*"),
    cued("device", "DEVICE", rf"serial{WITH_NUM}|s/n|udi|imei|lot{WITH_NUM}|device\s*id|implant\s*id", IDVAL, check=v.at_least(3), digits=3, needs="serial s/n udi imei lot device implant"),
    Rule("itin", "SSN", r"\b9\d{2}-(?:5\d|6[0-5]|7\d|8[0-8]|9[0-2]|9[4-9])-\d{4}\b", confidence=0.95, digits=9, needs=("-",)),
    Rule("ein", "ID", r"\b\d{2}-\d{7}\b", confidence=0.9, digits=9, needs=("-",)),
    Rule("aba", "ACCOUNT", r"\b\d{9}\b", confidence=0.9, check=v.valid_aba, digits=9),
    Rule("iban", "ACCOUNT", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", confidence=0.9, check=v.valid_iban, digits=8),
    Rule("docket", "ID", r"(?i)\b\d{1,2}:\d{2}-(?:cv|cr|mc|md|bk|ap|mj)-\d{3,6}(?:-[A-Z]{2,4})?\b", confidence=0.95, digits=6, needs=(":",)),
    Rule("court", "ID", rf"\b(?:CV|CR|CIV|FAM|PR)-{YEAR}-\d{{4,8}}\b", confidence=0.95, digits=8),
    cued("matter", "ID", rf"(?:docket|case|cause|file|matter|client-matter|bar|employee|ein|tin|itin|claim)\s*{NUM_OR_ID}?", IDVAL, 0.9, v.at_least(4), 4),
    cued("mrn_spoken", "MRN", rf"mrn|medical record{WITH_NUM}|patient\s?id|chart\s*{NUM}|hospital\s*{NUM}", SPOKEN, 0.95, v.at_least(4), 4, "mrn medical patient chart hospital", SAID),
    cued("plan_spoken", "PLAN", rf"{PLAN_CUES}\s*{NUM_OR_ID}|mbi|hicn|hcn|health\s*card", SPOKEN, 0.95, v.at_least(4), 4, "member policy subscriber group insurance beneficiary medica plan health ohip nhs mbi hicn hcn", SAID),
    cued("id_spoken", "ID", rf"(?:account|acct\.?|invoice|claim|encounter|accession|case|reference|confirmation|billing|specimen|serial|licen[sc]e|passport)\s*{NUM_OR_ID}", SPOKEN, 0.9, v.at_least(4), 4, "acc invoice claim encounter case reference confirmation billing specimen serial licen passport", SAID),
    cued("ssn_spoken", "SSN", r"social security(?:\s*number)?|ssn", r"(\d(?:[ -]?\d){8})\b", 0.95, digits=9, needs="social ssn", between=SAID),
    Rule("digits_spoken", "ID", r"\b\d(?: \d){6,}\b", confidence=0.85, digits=7),
    Rule("date_ordinal_of", "DATE", rf"(?i:\b(?:the\s+)?{ORDINAL}\s+(?:day\s+)?of\s+){MONTH}(?:,?\s+(?:of\s+)?{YEAR})?\b", confidence=0.9, needs=MONTHS_LOW, also=ORDINALS_LOW),
    Rule("date_month_ordinal", "DATE", rf"\b{MONTH}\s+(?i:(?:the\s+)?{ORDINAL})(?:,?\s+{YEAR})?\b", confidence=0.9, needs=MONTHS_LOW, also=ORDINALS_LOW),
    Rule("age_spoken", "AGE", r"(?i)\b((?:ninety(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?|(?:one |a )?hundred(?: and)?(?: (?:one|two|three|four|five|six|seven|eight|nine|ten))?))[\s-]+(?:years?[\s-]+old|year[\s-]+old|years of age)\b", 1, 0.95, needs=("ninety", "hundred")),
    Rule("email_spoken", "EMAIL", r"(?i)\b[a-z0-9]+(?: (?:dot|underscore|dash|hyphen) [a-z0-9]+)* at [a-z0-9]+(?: (?:dot|dash|hyphen) [a-z0-9]+)* dot (?:com|org|net|ca|edu|gov|io|co|uk|us|health|info)\b", confidence=0.9, needs=(" dot ",)),
    Rule("any_id", "ID", rf"(?i)\b[a-z]+\s+id{TO_VALUE}{IDVAL}", 1, 0.8, v.at_least(4), digits=4, needs=("id",)),
    Rule("date_of_birth", "DATE", rf"(?i)\b(?:dob|d\.o\.b\.?|date of birth|birth\s?date|born(?:\s+on)?)\s*[:\-]?\s*({NUMERIC_DATE}|{NAMED_DATE})", 1, dob=True, digits=3, needs=("dob", "d.o.b", "birth", "born")),
    Rule("date_iso", "DATE", rf"\b{YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)?", digits=8, needs=("-",)),
    Rule("date_us", "DATE", rf"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:{YEAR}|\d{{2}})\b", digits=4, needs=("/", "-")),
    Rule("date_day_first", "DATE", rf"\b(?:1[3-9]|2\d|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:{YEAR}|\d{{2}})\b", confidence=0.95, digits=5, needs=("/", "-", ".")),
    Rule("date_dotted", "DATE", rf"\b(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.{YEAR}\b", confidence=0.95, digits=6, needs=(".",)),
    Rule("date_named", "DATE", rf"\b(?:(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)[a-z]*\.?,?\s+)?{MONTH}\.?\s+{DAY}(?:,?\s+{YEAR})?\b", confidence=0.95, digits=1, needs=MONTHS_LOW),
    Rule("date_day_month", "DATE", rf"\b{DAY}[\s-]+{MONTH}\.?(?:,?[\s-]+(?:{YEAR}|\d{{2}}))?\b", confidence=0.95, digits=1, needs=MONTHS_LOW),
    Rule("date_month_year", "DATE", rf"\b{MONTH}\.?,?\s+(?:of\s+)?{YEAR}\b", confidence=0.9, digits=4, needs=MONTHS_LOW),
    Rule("date_cued", "DATE", rf"(?i)\b(?:on|since|until|from|dated?|dos|admitted|discharged|seen|scheduled(?:\s+for)?|follow[- ]?up|f/u|appointment|appt\.?|surgery|due)\s*:?\s+({MON_DAY})\b", 1, 0.7, digits=2, needs=("/",)),
    Rule("date_before_visit", "DATE", rf"\b({MON_DAY})\s+(?:appointment|appt|visit|admission|surgery|clinic|encounter|procedure)\b", 1, 0.7, digits=2, needs=("/",)),
    Rule("month_cued", "DATE", rf"(?i:\b(?:last|this|next|in|since|until|early|late|mid|by|of)[\s-]+)({MONTH})\b", 1, 0.7, needs=MONTHS_LOW),
    Rule("age", "AGE", r"(?i)\b(\d{2,3})[\s-]*(?:y/?o|yrs?\.?(?:[\s-]*old)?|years?(?:[\s-]*old|[\s-]+of[\s-]+age)|year[\s-]*old)\b", 1, 1.0, v.age_over_89, digits=2, needs=("y",)),
    Rule("age_cued", "AGE", r"(?i)\b(?:age[d]?\s*(?:of|is|:)?|turned|turning)\s*(\d{2,3})\b", 1, 1.0, v.age_over_89, digits=2, needs=("age", "turn")),
    Rule("address", "ADDRESS", rf"\b\d{{1,6}}[A-Za-z]?\s+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?\s+)?(?:(?:[A-Z][A-Za-z'’]+|\d{{1,3}}(?:st|nd|rd|th))\.?\s+){{1,4}}{STREET}\b\.?(?:,?\s+(?i:apt|apartment|suite|ste|unit|rm|room|bldg|floor|fl|#)\.?\s*#?[A-Za-z0-9-]+)?", confidence=0.95, digits=1),
    Rule("po_box", "ADDRESS", r"(?i)\bP\.?\s?O\.?\s+Box\s+\d+\b", digits=1, needs=("box",)),
    Rule("zip_state", "ZIP", rf"\b{STATE}\.?,?\s+(\d{{5}}(?:-\d{{4}})?)\b", 1, 0.95, digits=5),
    cued("zip_cued", "ZIP", r"(?:zip|postal)(?:\s*code)?", r"(\d{5}(?:-\d{4})?)\b", digits=5, needs="zip postal", between=r"\s*[:#]?\s*"),
    Rule("city_state", "LOCATION", rf"\b([A-Z][a-z]+(?:[ -][A-Z][a-z]+){{0,2}}),\s+{STATE}\.?,?\s+\d{{5}}\b", 1, 0.9, digits=5, needs=(",",)),
    Rule("postal_canada", "ZIP", r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z][ -]?\d[ABCEGHJ-NPRSTV-Z]\d\b", confidence=0.95, digits=3),
    Rule("name_titled", "NAME", rf"\b(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof|Sr|Sra|Nurse|Doctor|Officer|Constable|Detective|Pharmacist|Rev|Fr|Judge|Sgt|Capt)\.?\s+({names.FULL})", 1, 0.9, cased=tuple("Dr Mr Ms Miss Mx Prof Sr Nurse Doctor Officer Constable Detective Pharmacist Rev Fr Judge Sgt Capt".split())),
    Rule("name_registered", "NAME", rf"\b({names.REGISTERED})\s+(?:\d{{1,3}}\s*(?:y/?o|yrs?)|DOB|MRN|\(|[MF]\b)", 1, 0.9, needs=(",",), capitals=True),
    Rule("name_role_registered", "NAME", rf"\b(?:Patient|Pt|Client|Resident)\s+({names.REGISTERED})", 1, 0.9, needs=(",",), cased=("Patient", "Pt", "Client", "Resident"), capitals=True),
    Rule("name_capitals", "NAME", rf"\b({names.CTOK}(?:\s+{names.CTOK}){{0,2}},\s*{names.CTOK}(?:\s+[A-Z]\b\.?)?)", 1, 0.9, names.name_pair, needs=(",",), capitals=True),
    Rule("name_addressed", "NAME", rf"(?i:\b(?:from|to|sent|attn|attention|cc|bcc|copied|fwd?|fw|forwarded|between)\s*[:–—-]\s*|\b(?:care\s+of|c/o|attention\s+of|addressed\s+to|delivered\s+to|copied\s+to|sent\s+to|forwarded\s+to|between)\s+)\s*(?:(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof)\.?\s+)?({names.PAIR})", 1, 0.8, names.name_pair, needs=(",",), also=(":", "–", "—", "-", "care", "c/o", "attention", "addressed", "delivered", "copied", "sent", "forwarded", "between")),
    Rule("name_then_facts", "NAME", rf"\b({names.PAIR})\s+\(?(?:{YEAR}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|(?i:d\.?o\.?b\.?|mrn|m\.?r\.?#|chart|med\.?\s?rec\.?|age|male|female|born)\b|\d{{1,3}}\s*(?:y/?o|yrs?\.?)\b)", 1, 0.8, names.name_pair, needs=(",",), also=(*"0123456789", "dob", "d.o", "do.b", "mrn", "m.r", "mr.", "mr#", "chart", "med", "age", "male", "born")),
    Rule("name_labelled", "NAME", rf"(?i:\b(?:patient(?:\s+name)?|pt|name|client|resident|attending|provider|physician|surgeon|referring(?:\s+(?:physician|provider|md))?|pcp|emergency\s+contact|next\s+of\s+kin|nok|guardian|spouse|mother|father|daughter|son|wife|husband|partner|signed(?:\s+by)?|dictated\s+by|reviewed\s+by|seen\s+by|ordered\s+by|cc|author|re|assistant|an(?:a)?esthesiologist|an(?:a)?esthetist|proband|interpreter|social\s+worker|contact|caller|informant|witness))\s*:\s*(?:(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof)\.?\s+)?((?:{names.NTOK},\s*)?{names.FULL})", 1, 0.85, names.name_or_pair, needs=(":",)),
    Rule("name_credential", "NAME", rf"\b({names.NTOK}(?:\s+[A-Z]\.)?\s+{names.NTOK}),?\s+(?:M\.?D\.?|D\.?O\.?|R\.?N\.?|N\.?P\.?|PA-C|Ph\.?D\.?|DDS|DPM|PharmD|LCSW|CRNA|FNP|APRN|MBBS|FRCPC)\b", 1, 0.9, cased=tuple("MD M.D DO D.O RN R.N NP N.P PA-C PhD Ph.D DDS DPM PharmD LCSW CRNA FNP APRN MBBS FRCPC".split())),
    Rule("name_relative", "NAME", rf"(?i:\b(?:daughter|son|wife|husband|mother|father|brother|sister|spouse|partner|friend|neighbou?r|caregiver|niece|nephew|aunt|uncle|grand(?:mother|father|son|daughter)|roommate|boyfriend|girlfriend|fianc[ée]e?)),?\s+({names.NTOK}(?:\s+{names.NTOK})?)", 1, 0.8, needs=tuple("daughter son wife husband mother father brother sister spouse partner friend neighbo caregiver niece nephew aunt uncle roommate fianc".split())),
    Rule("city_province", "LOCATION", rf"\b([A-Z][a-z]+(?:[ -][A-Z][a-z]+){{0,2}}),\s+{PROVINCE}\.?,?\s+[A-Z]\d[A-Z][ -]?\d[A-Z]\d\b", 1, 0.9, digits=3, needs=(",",)),
]
