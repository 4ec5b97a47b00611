"""Checks of identifier values: Catalyst columns, and the same checks on Python strings for the detection stage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: VIN letters' numbers, and position weights.
VIN_VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9, *range(10)], strict=True))
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]

# --- Python --------------------------------------------------------------------------------------------------------


def digits(v: str) -> str:
    return re.sub("[^0-9]", "", v)


def at_least(n: int):
    return lambda v: len(digits(v)) >= n


def luhn(v: str) -> bool:
    d = digits(v)
    double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(double) % 10 == 0


def valid_ssn(v: str) -> bool:
    d = digits(v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def valid_vin(v: str) -> bool:
    v = v.upper()
    if len(v) != 17 or not 3 <= len(digits(v)) <= 14 or any(c not in VIN_VALUES for c in v):
        return False
    left = sum(VIN_VALUES[c] * w for c, w in zip(v, VIN_WEIGHTS, strict=True)) % 11
    return v[8] == ("X" if left == 10 else str(left))


def valid_aba(v: str) -> bool:
    d = digits(v)
    return len(d) == 9 and sum(int(c) * w for c, w in zip(d, (3, 7, 1) * 3, strict=True)) % 10 == 0 and len(set(d)) > 1


def valid_iban(v: str) -> bool:
    s = "".join(v.split())
    return 15 <= len(s) <= 34 and len(digits(s)) >= 8 and s[:2].isupper() and s[:2].isalpha()


def age_over_89(v: str) -> bool:
    return v.isascii() and v.isdigit() and 90 <= int(v) <= 125


def not_all_same(v: str) -> bool:
    d = digits(v)
    return len(d) >= 7 and len(set(d)) > 1


# --- Catalyst ------------------------------------------------------------------------------------------------------


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def digit_count(v: Column) -> Column:
    return F.length(digits_of(v))


def is_luhn(v: Column) -> Column:
    return digit_count(v).between(13, 19) & F.call_function("luhn_check", digits_of(v))


def is_ssn(v: Column) -> Column:
    d = digits_of(v)
    return (F.length(d) == 9) & ~d.substr(1, 3).isin("000", "666") & (d.substr(1, 1) != "9") & (d.substr(4, 2) != "00") & (d.substr(6, 4) != "0000")


def weighted(v: Column, values: Column, weights: list[int]) -> Column:
    """Sum over positions of the number of v's character times its weight."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(weights))), F.lit(0), lambda s, i: s + F.coalesce(F.element_at(values, F.substring(v, i, F.lit(1))).cast("int"), F.lit(0)) * F.element_at(w, i))


def is_vin(v: Column) -> Column:
    u = F.upper(v)
    values = F.create_map(*[F.lit(x) for kv in VIN_VALUES.items() for x in kv])
    left = F.pmod(weighted(u, values, VIN_WEIGHTS), F.lit(11))
    return u.rlike("^[A-HJ-NPR-Z0-9]{17}$") & digit_count(u).between(3, 14) & (u.substr(9, 1) == F.when(left == 10, F.lit("X")).otherwise(left.cast("string")))


def is_aba(v: Column) -> Column:
    d = digits_of(v)
    values = F.create_map(*[F.lit(x) for i in range(10) for x in (str(i), i)])
    return (F.length(d) == 9) & (F.pmod(weighted(d, values, [3, 7, 1] * 3), F.lit(10)) == 0) & (F.length(F.replace(d, d.substr(1, 1), F.lit(""))) > 0)


def is_iban(v: Column) -> Column:
    s = F.regexp_replace(v, r"\s", "")
    return F.length(s).between(15, 34) & (digit_count(s) >= 8) & s.rlike("^[A-Z]{2}")


def is_age_over_89(v: Column) -> Column:
    return F.coalesce(v.rlike("^[0-9]{2,3}$") & v.try_cast("int").between(90, 125), F.lit(False))


def is_not_all_same(v: Column) -> Column:
    d = digits_of(v)
    return (F.length(d) >= 7) & (F.length(F.replace(d, d.substr(1, 1), F.lit(""))) > 0)
