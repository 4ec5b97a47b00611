"""Foreign label vocabularies mapped to categories by an ordered keyword table: one CASE, in Catalyst or SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .categories import CATEGORIES

#: Fixed values, first match wins: (result, substrings, whole labels, endings, exceptions). KEEP is no identifier; QUASI one only in strict policies.
RULES: list[tuple[str, str, str, str]] = [
    ("ID", "docket case_number matter", "", ""),
    ("EMAIL", "email", "", ""),
    ("FAX", "fax", "", ""),
    ("PHONE", "phone telephone mobile", "tel", ""),
    ("IP", "ipv4 ipv6 ip_address", "ip ipaddress", ""),
    ("DEVICE", "mac_address device imei serial", "", ""),
    ("URL", "url website http_cookie", "", ""),
    ("SSN", "ssn social_security socialnum", "", ""),
    ("ID", "taxnum idcardnum", "", ""),
    ("ADDRESS", "buildingnum", "", ""),
    ("ID", "", "private pii sensitive", ""),
    ("MRN", "medical_record patient_id", "mrn medicalrecord", ""),
    ("PLAN", "health_plan beneficiary insurance", "healthplan", ""),
    ("VEHICLE", "license_plate vehicle vrm", "vin", ""),
    ("LICENSE", "license licence certificate", "", ""),
    ("BIOMETRIC", "biometric", "", ""),
    ("DATE", "date birth", "dob", ""),
    ("KEEP", "", "time", ""),
    ("AGE", "", "age", ""),
    ("ZIP", "postcode zip postal", "", ""),
    ("ADDRESS", "street address building coordinate gps", "", ""),
    ("KEEP", "", "state country", ""),
    ("LOCATION", "city county location hospital", "loc", ""),
    ("ACCOUNT", "account routing iban swift bic credit card bitcoin ethereum litecoin", "cvv pin", ""),
    ("ID", "password api_key secret user_name username", "", ""),
    ("NAME_OR_ORG", "name private_person", "person per patient doctor staff hcw", ""),
    ("ID", "national_id tax_id passport customer_id employee_id unique_id idnum", "id", "_id"),
    ("QUASI", "org company vendor", "", ""),
    ("QUASI", "occupation profession job nationality religio political sexual ethnic race marital education employment language", "", ""),
]
COMPANY = "company organization organisation".split()


def stripped(label: Column) -> Column:
    """Without one BIO(ES) prefix, in lower case, blanks and hyphens as underscores."""
    bare = F.when((F.length(label) > 2) & label.rlike("^[BIESLU][-_]"), F.expr("1=1")).otherwise(F.lit(False))
    return F.translate(F.lower(F.when(bare, F.substr(label, F.lit(3))).otherwise(label)), "- ", "__")


def map_label(label: Column) -> Column:
    """Category, QUASI or KEEP of a raw label; null stays KEEP."""
    x = stripped(label)
    out = F.when(label.isNull() | x.isin("o", ""), "KEEP").when(x == "org", "QUASI").when(F.upper(x).isin(CATEGORIES), F.upper(x))
    for result, inside, whole, ending in RULES:
        tests = [x.contains(k) for k in inside.split()] + ([x.isin(whole.split())] if whole else []) + ([x.endswith(ending)] if ending else [])
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        value = F.lit(result)
        if result == "NAME_OR_ORG":
            company = x.contains(COMPANY[0]) | x.contains(COMPANY[1]) | x.contains(COMPANY[2])
            value = F.when(company, "QUASI").otherwise("NAME")
        out = out.when(test, value)
    return out.otherwise("KEEP")


def label_sql(label: str, matches: str = "regexp_matches") -> str:
    """The same CASE as SQL text; matches is the engine's function for a regular expression."""
    bare = f"CASE WHEN length({label}) > 2 AND {matches}({label}, '^[BIESLU][-_]') THEN substr({label}, 3) ELSE {label} END"
    x = f"translate(lower({bare}), '- ', '__')"
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    lines = [f"WHEN {label} IS NULL OR {x} IN ('o', '') THEN 'KEEP'", f"WHEN {x} = 'org' THEN 'QUASI'", f"WHEN upper({x}) IN ({quoted(CATEGORIES)}) THEN upper({x})"]
    for result, inside, whole, ending in RULES:
        tests = [f"contains({x}, '{k}')" for k in inside.split()] + ([f"{x} IN ({quoted(whole.split())})"] if whole else []) + ([f"right({x}, {len(ending)}) = '{ending}'"] if ending else [])
        value = "CASE WHEN " + " OR ".join(f"contains({x}, '{k}')" for k in COMPANY) + " THEN 'QUASI' ELSE 'NAME' END" if result == "NAME_OR_ORG" else f"'{result}'"
        lines.append(f"WHEN {' OR '.join(tests)} THEN {value}")
    return "CASE " + " ".join(lines) + " ELSE 'KEEP' END"
