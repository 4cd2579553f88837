"""Structural checks on a matched value, as boolean columns (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.core import chars, let, strip

Check = Callable[[Column], Column]

# Nine-digit strings that only ever appear as placeholders.
SSN_PLACEHOLDERS = ("123456789", "111111111", "000000000")
# Limits of the checks.
LUHN_MIN_DIGITS = 12
IBAN_LENGTHS = (15, 34)
MOD11_MIN_DIGITS = 8
ENTROPY_MIN_CHARS, ENTROPY_MIN_BITS = 16, 3.0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + x)


def luhn(value: Column) -> Column:
    def from_right(digit: Column, place: Column) -> Column:
        doubled = digit.cast("int") * 2
        spread = F.when(doubled > 9, doubled - 9).otherwise(doubled)
        return F.when(place % 2 == 1, spread).otherwise(digit.cast("int"))

    return let(
        digits_of(value),
        lambda d: F.when(F.length(d) < LUHN_MIN_DIGITS, F.lit(False)).otherwise(
            _total(F.transform(chars(F.reverse(d)), from_right)) % 10 == 0
        ),
    )


def iban(value: Column) -> Column:
    """Mod-97 by running remainder, so no wide integer is needed."""

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise(
            (rest * 10 + code - 48) % 97
        )

    return let(
        F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")),
        lambda c: F.when(
            F.length(c).between(*IBAN_LENGTHS),
            F.aggregate(
                chars(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))), F.lit(0), step
            )
            == 1,
        ).otherwise(F.lit(False)),
    )


def us_ssn(value: Column) -> Column:
    def issued(d: Column) -> Column:
        area = F.substring(d, 1, 3)
        return (
            (F.length(d) == 9)
            & ~area.isin("000", "666")
            & (F.substring(d, 1, 1) != "9")
            & (F.substring(d, 4, 2) != "00")
            & (F.substring(d, 6, 4) != "0000")
            & ~d.isin(*SSN_PLACEHOLDERS)
        )

    return let(digits_of(value), issued)


def nhs_number(value: Column) -> Column:
    def passes(d: Column) -> Column:
        weighted = _total(
            F.transform(chars(F.substring(d, 1, 9)), lambda x, i: x.cast("int") * (F.lit(10) - i))
        )
        # The check digit is 11 minus the remainder, written 0 for 11; 10 is never issued.
        rest = weighted % 11
        return (rest != 1) & ((F.lit(11) - rest) % 11 == F.substring(d, 10, 1).cast("int"))

    return let(
        digits_of(value), lambda d: F.when(F.length(d) == 10, passes(d)).otherwise(F.lit(False))
    )


def mod11(value: Column) -> Column:
    def passes(d: Column) -> Column:
        body = F.reverse(F.substr(d, F.lit(1), F.length(d) - 1))
        weighted = _total(F.transform(chars(body), lambda x, i: x.cast("int") * (i % 6 + 2)))
        rest = weighted % 11
        check = F.when(rest <= 1, F.lit(0)).otherwise(F.lit(11) - rest)
        return check == F.right(d, F.lit(1)).cast("int")

    return let(
        digits_of(value),
        lambda d: F.when(F.length(d) >= MOD11_MIN_DIGITS, passes(d)).otherwise(F.lit(False)),
    )


def entropy_bits(value: Column) -> Column:
    """Shannon entropy in bits of the characters of ``value``."""
    return let(
        chars(value),
        lambda cs: -F.aggregate(
            F.transform(
                F.array_distinct(cs),
                lambda c: F.size(F.filter(cs, lambda x: x == c)) / F.size(cs).cast("double"),
            ),
            F.lit(0.0),
            lambda acc, p: acc + p * F.log2(p),
        ),
    )


def entropy(value: Column) -> Column:
    return let(
        strip(value),
        lambda s: F.when(F.length(s) < ENTROPY_MIN_CHARS, F.lit(False)).otherwise(
            F.round(entropy_bits(s), 12) >= ENTROPY_MIN_BITS
        ),
    )


def always(value: Column) -> Column:
    return F.lit(True)


# Names under which rules ask for a check.
CHECKS: dict[str, Check] = {
    "none": always,
    "always": always,
    "luhn": luhn,
    "iban": iban,
    "us_ssn": us_ssn,
    "nhs_number": nhs_number,
    "mod11": mod11,
    "entropy": entropy,
}


class UnknownCheck(ValueError):
    """A rule names a check that is not registered."""


def register_check(name: str, check: Check) -> None:
    """Add a check under ``name``. A column function stays in the JVM; where no column form
    exists, a pandas UDF has the same call shape and can be passed as it is."""
    CHECKS[name] = check


def check_named(name: str | None) -> Check:
    if not name:
        return always
    if name not in CHECKS:
        raise UnknownCheck(f"unknown check {name!r}; known: {', '.join(sorted(CHECKS))}")
    return CHECKS[name]


def dispatch(name: Column, value: Column) -> Column:
    """Check chosen per row by a name column; an unregistered name gives null."""
    out = F.when(name.isNull() | (name == ""), F.lit(True))
    for known, check in CHECKS.items():
        out = out.when(name == known, check(value))
    return out
