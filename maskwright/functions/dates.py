"""Years, ZIP prefixes and date shifts of identifier strings, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-digit ZIP prefixes of areas with too few residents.
SPARSE_ZIP3 = "036 059 063 102 203 556 692 790 821 823 830 831 878 879 884 890 893".split()
MONTHS = "January February March April May June July August September October November December".split()


def year_of(v: Column, now: int) -> Column:
    """First year 19xx or 20xx; else the two-digit year at the end of a numeric date, no later than next year."""
    four = F.regexp_extract(v, r"(?<![0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])", 1)
    two = F.regexp_extract(v, r"[/.\- ]([0-9]{2})$", 1)
    numeric = F.length(F.regexp_replace(v, r"[^/.\-]", "")) >= 2
    short = F.when((two != "") & numeric, two.cast("int"))
    return F.when(four != "", four.cast("int")).otherwise(F.when(2000 + short <= now + 1, 2000 + short).otherwise(1900 + short))


def date_suffix(v: Column, dob: Column, now: int) -> Column:
    y = year_of(v, now)
    return F.when(y.isNotNull() & ~(dob & (F.lit(now) - y >= 90)), F.concat(F.lit(":"), y.cast("string"))).otherwise("")


def zip_suffix(v: Column) -> Column:
    d = F.substring(F.regexp_replace(v, "[^0-9]", ""), 1, 3)
    fits = (F.length(d) == 3) & (F.length(F.trim(v)) <= 10) & F.trim(v).rlike("^[0-9]")
    return F.when(fits, F.concat(F.lit(":"), F.when(d.isin(SPARSE_ZIP3), "000").otherwise(d))).otherwise("")


def ordinal(day: Column) -> Column:
    return F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")


def padded(v: Column, width: int) -> Column:
    return F.lpad(v.cast("string"), width, "0")


def shift_date(v: Column, days: Column) -> Column:
    """v moved by days in its own format (ISO with its tail, numeric, named month); null where that can't be done.

    A day-first date stays one: the result is null if its day would no longer tell it from a month-first date.
    """
    part = lambda pattern, i: F.regexp_extract(v, pattern, i)
    day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", padded(y, 4), padded(m, 2), padded(d, 2)), "yyyy-MM-dd")
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([\s\S]*)$"
    moved = F.date_add(day_of(part(iso, 1), part(iso, 2), part(iso, 3)), days)
    as_iso = F.concat(F.date_format(moved, "yyyy-MM-dd"), part(iso, 4))

    num = r"^([0-9]{1,2})([/.-])([0-9]{1,2})[/.-]([0-9]{4})$"
    a, sep, b, y = (part(num, i) for i in (1, 2, 3, 4))
    day_first = a.try_cast("int") > 12
    moved = F.date_add(day_of(y, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)), days)
    first, second = F.when(day_first, F.day(moved)).otherwise(F.month(moved)), F.when(day_first, F.month(moved)).otherwise(F.day(moved))
    pad = (F.length(a) == 2) & (F.length(b) == 2)
    number = lambda n: F.when(pad, padded(n, 2)).otherwise(n.cast("string"))
    as_num = F.when(day_first & (first <= 12), F.lit(None)).otherwise(F.concat(number(first), sep, number(second), sep, F.year(moved).cast("string")))

    named = r"^([A-Za-z]{3,9})(\.?)\s+([0-9]{1,2})(st|nd|rd|th)?(,?)\s+([0-9]{4})$"
    word, dot, d, suffix, comma, y = (part(named, i) for i in range(1, 7))
    names = F.array(*map(F.lit, MONTHS))
    month = F.array_position(F.transform(names, lambda n: F.lower(n).startswith(F.lower(word)) | ((F.lower(word) == "sept") & (n == "September"))), F.lit(True))
    moved = F.date_add(day_of(y, F.when(month > 0, month.cast("int")), d), days)
    full = F.element_at(names, F.month(moved))
    short = (F.length(word) <= 4) & (F.length(full) > F.length(word))
    name = F.when(short, F.substring(full, 1, 3)).otherwise(full)
    name = F.when(word == F.upper(word), F.upper(name)).otherwise(name)
    as_named = F.concat(name, F.when(short, dot).otherwise(""), F.lit(" "), F.day(moved).cast("string"), F.when(suffix != "", ordinal(F.day(moved))).otherwise(""), comma, F.lit(" "), F.year(moved).cast("string"))
    return F.when(v.rlike(iso), as_iso).when(v.rlike(num), as_num).when(v.rlike(named), as_named)
