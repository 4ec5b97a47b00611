"""One planted sentence for each rule, made of table rows by one SQL text that Spark and DuckDB share."""

from __future__ import annotations

from .notes import digits, text

K = "c_custkey"
LETTER = "substr('ABCDEFGHJKLMNPRSTUVWXYZ', CAST({} % 23 AS INT) + 1, 1)"
MON = "substr('JanFebMarAprJunJulAugSepOctNovDec', CAST(c_custkey % 11 AS INT) * 3 + 1, 3)"
GIVEN = "substr('KarenPriyaHelenOscarMaria', CAST(c_custkey % 5 AS INT) * 5 + 1, 5)"
FAMILY = "substr('WhitfieldBrannigonMacdonaldOkonkwoosRasmussen', CAST(c_custkey % 5 AS INT) * 9 + 1, 9)"
CAPS = f"upper({FAMILY}) || ', ' || upper({GIVEN})"
MIXED = f"{FAMILY} || ', ' || {GIVEN}"
DAY, MONTH = digits(f"{K} % 28 + 1", 2), digits(f"{K} % 12 + 1", 2)
D4, D5, D6, D7, D8 = (digits(K, n) for n in (4, 5, 6, 7, 8))
PHONE = f"'217-555-' || {D4}"
YEAR = text(f"{K} % 30 + 1990")
OLD = text(f"{K} % 10 + 90")
SPOKEN = "substr('firstthirdfifthsixthninth', CAST(c_custkey % 5 AS INT) * 5 + 1, 5)"

#: rule: (category, text before, SQL of the value, text after).
CASES: dict[str, tuple[str, str, str, str]] = {
    "email": ("EMAIL", "Write to ", f"'a.b' || {text(K)} || '@mail.example.org'", " soon."),
    "url": ("URL", "See ", f"'https://example.org/p?q=' || {text(K)}", ", please."),
    "ipv4": ("IP", "Host ", f"'10.' || {text(f'{K} % 256')} || '.7.' || {text(f'{K} % 100')}", " logged."),
    "ipv6": ("IP", "Host ", f"'2001:0db8:85a3:0000:0000:8a2e:0370:' || {D4}", " logged."),
    "ipv6_short": ("IP", "Host ", f"'fe80::1:' || {D4}", " logged."),
    "mac": ("DEVICE", "Card ", f"'00:1A:2b:3c:4d:' || {digits(f'{K} % 100', 2)}", " seen."),
    "fax": ("FAX", "Fax: ", PHONE, " now."),
    "phone": ("PHONE", "Reach us at ", f"'(217) 555-' || {D4}", " today."),
    "phone_international": ("PHONE", "Reach us at ", f"'+44 20 7946 ' || {D4}", " today."),
    "phone_cued": ("PHONE", "Cell: ", f"'555-' || {D4}", " today."),
    "ssn": ("SSN", "Given ", f"'123-45-' || {digits(f'{K} % 9999 + 1', 4)}", " there."),
    "ssn_cued": ("SSN", "SSN ", f"'xxx-xx-' || {D4}", " there."),
    "mrn": ("MRN", "MRN: ", D8, " opened."),
    "plan": ("PLAN", "Member ID: ", f"'XJK' || {D6} || 'A'", " valid."),
    "account": ("ACCOUNT", "Account number ", D8, " open."),
    "card": ("ACCOUNT", "Paid by ", "'4111 1111 1111 1111'", " today."),
    "license": ("LICENSE", "Driver's license ", f"'D' || {D7}", " shown."),
    "vin": ("VEHICLE", "Car ", "'1HGCM82633A004352'", " parked."),
    "vin_cued": ("VEHICLE", "VIN: ", f"'1HGCM82633A0' || {digits(f'{K} % 100000', 5)}", " parked."),
    "plate": ("VEHICLE", "Plate: ", f"'KLM' || {D4}", "; parked."),
    "device": ("DEVICE", "Serial number: ", f"'PJK-' || {D6}", " fitted."),
    "itin": ("SSN", "Filed ", f"'912-70-' || {D4}", " late."),
    "ein": ("ID", "Filed ", f"'12-' || {D7}", " late."),
    "aba": ("ACCOUNT", "Wire to ", "'021000021'", " now."),
    "iban": ("ACCOUNT", "Wire to ", "'GB82 WEST 1234 5698 7654 32'", ", now."),
    "docket": ("ID", "In ", f"'2:25-cv-' || {D5}", ", today."),
    "court": ("ID", "In ", f"'CV-2024-' || {D6}", " today."),
    "matter": ("ID", "Matter number: ", f"'M' || {D6}", " opened."),
    "mrn_spoken": ("MRN", "MRN is ", f"'12 34 56 ' || {digits(f'{K} % 100', 2)}", ", she said."),
    "plan_spoken": ("PLAN", "Policy number is ", f"'77 81 90 ' || {digits(f'{K} % 100', 2)}", ", she said."),
    "id_spoken": ("ID", "Claim number is ", f"'41 52 63 ' || {digits(f'{K} % 100', 2)}", ", she said."),
    "ssn_spoken": ("SSN", "Social security number is ", f"'1 2 3 4 5 6 7 8 ' || {text(f'{K} % 10')}", ", she said."),
    "digits_spoken": ("ID", "It reads ", f"'4 0 2 9 1 7 ' || {text(f'{K} % 10')}", ", she said."),
    "date_ordinal_of": ("DATE", "Due on ", f"'the ' || {SPOKEN} || ' of March'", ", then."),
    "date_month_ordinal": ("DATE", "Due on ", f"'March ' || {SPOKEN}", ", then."),
    "age_spoken": ("AGE", "She is ", "'ninety-' || substr('onetwosix', CAST(c_custkey % 3 AS INT) * 3 + 1, 3)", " years old now."),
    "email_spoken": ("EMAIL", "Write to ", f"'anna' || {text(K)} || ' dot berg at example dot org'", ", please."),
    "any_id": ("ID", "Badge ID: ", f"'QX' || {D6}", " worn."),
    "date_of_birth": ("DATE", "DOB: ", f"{MONTH} || '/' || {DAY} || '/' || {YEAR}", " given."),
    "date_iso": ("DATE", "Seen ", f"{YEAR} || '-' || {MONTH} || '-' || {DAY}", " there."),
    "date_us": ("DATE", "Seen ", f"{MONTH} || '/' || {DAY} || '/' || {YEAR}", " there."),
    "date_day_first": ("DATE", "Seen ", f"{text(f'{K} % 16 + 13')} || '/' || {MONTH} || '/' || {YEAR}", " there."),
    "date_dotted": ("DATE", "Seen ", f"{DAY} || '.' || {MONTH} || '.' || {YEAR}", " there."),
    "date_named": ("DATE", "Seen ", f"{MON} || ' ' || {text(f'{K} % 28 + 1')} || ', ' || {YEAR}", " there."),
    "date_day_month": ("DATE", "Seen ", f"{text(f'{K} % 28 + 1')} || ' ' || {MON} || ' ' || {YEAR}", " there."),
    "date_month_year": ("DATE", "Seen ", f"{MON} || ' ' || {YEAR}", " there."),
    "date_cued": ("DATE", "Follow-up: ", f"{MONTH} || '/' || {DAY}", " there."),
    "date_before_visit": ("DATE", "The ", f"{MONTH} || '/' || {DAY}", " appointment stands."),
    "month_cued": ("DATE", "Back since ", "substr('MarchAprilAugus', CAST(c_custkey % 2 AS INT) * 5 + 1, 5)", ", then."),
    "age": ("AGE", "She is ", OLD, " years old now."),
    "age_cued": ("AGE", "She turned ", OLD, " then."),
    "address": ("ADDRESS", "Lives at ", f"{text(f'{K} % 900 + 1')} || ' Wallaby Way, Apt 3B'", " now."),
    "po_box": ("ADDRESS", "Mail to ", f"'P.O. Box ' || {text(K)}", " now."),
    "zip_state": ("ZIP", "Moved to Springfield, IL ", digits(f"{K} % 90000 + 10000", 5), " then."),
    "zip_cued": ("ZIP", "Zip code: ", digits(f"{K} % 90000 + 10000", 5), " then."),
    "city_state": ("LOCATION", "Moved to ", "substr('Brookville  Chesterfield', CAST(c_custkey % 2 AS INT) * 12 + 1, CAST(c_custkey % 2 AS INT) * 2 + 10)", ", IL 62704."),
    "postal_canada": ("ZIP", "Sent to ", f"'M6H ' || {text(f'{K} % 10')} || 'B' || {text(f'{K} % 7')}", " then."),
    "name_titled": ("NAME", "Seen by Dr. ", f"{GIVEN} || ' ' || {FAMILY}", " then."),
    "name_registered": ("NAME", "Record of ", CAPS, " DOB unknown."),
    "name_role_registered": ("NAME", "Patient ", CAPS, " came."),
    "name_capitals": ("NAME", "Record of ", CAPS, " arrived."),
    "name_addressed": ("NAME", "Attn: ", MIXED, "; thanks."),
    "name_then_facts": ("NAME", "Contact ", MIXED, " MRN unknown."),
    "name_labelled": ("NAME", "Reviewed by: ", f"{GIVEN} || ' ' || {FAMILY}", "; done."),
    "name_credential": ("NAME", "Seen by ", f"{GIVEN} || ' ' || {FAMILY}", ", MD today."),
    "name_relative": ("NAME", "Her daughter ", GIVEN, " will drive."),
    "city_province": ("LOCATION", "Moved to ", "substr('Toronto Montreal', CAST(c_custkey % 2 AS INT) * 8 + 1, CAST(c_custkey % 2 AS INT) + 7)", ", ON M6H 4B6."),
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expected_sql() -> str:
    """rule, c_custkey, category, span_start, span_end of every planted value, each from its own rule."""
    one = "SELECT {key} AS doc_id, '{rule}' AS rule, '{category}' AS category, {n}::INT AS span_start, ({n} + length({value}))::INT AS span_end FROM customer"
    return " UNION ALL ".join(one.format(key=K, rule=r, category=c, n=len(before), value=v) for r, (c, before, v, _) in CASES.items())


def texts_sql() -> list[tuple[str, str]]:
    """(rule, SQL of its text) in Spark's dialect: quotes inside a literal by another literal."""
    spark = lambda s: "concat_ws(chr(39), " + ", ".join(f"'{part}'" for part in s.split("'")) + ")"
    return [(r, f"{spark(before)} || {v} || {spark(after)}") for r, (_, before, v, after) in CASES.items()]
