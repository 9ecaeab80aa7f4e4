"""Dates and amounts read from statement text."""

from __future__ import annotations

from ledgerflow.functions import vocabulary as v
from ledgerflow.functions.dialect import Dialect


def two_digit_year(year: str) -> str:
    """Years 0 to 68 are of this century, 69 to 99 of the last."""
    return f"(case when {year} >= 100 then {year} when {year} <= 68 then 2000 + {year} else 1900 + {year} end)"


def parsed_date(d: Dialect, x: str, year: str = "null", day_first: bool = True) -> str:
    """The date of a text in one of the known shapes, else null: ``09 AUG [26|2026]`` (``year`` where it has none; also
    with - or / between), ``2026-08-09`` and ``09/08/26|2026`` (each with one kind of - / . throughout).  Ordinal endings
    are ignored; a day that no month has is null."""
    text = d.replaced(f"upper(trim({x}))", r"\b([0-9]{1,2})(ST|ND|RD|TH)\b", "$1" if d.spark else r"\1")
    named = r"^([0-9]{1,2})[ /-]*(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*(?:[ /-]*([0-9]{4}|[0-9]{2}))?$"
    iso = r"^([0-9]{4})(?:-([0-9]{1,2})-([0-9]{1,2})|/([0-9]{1,2})/([0-9]{1,2})|\.([0-9]{1,2})\.([0-9]{1,2}))$"
    short = r"^([0-9]{1,2})(?:-([0-9]{1,2})-|/([0-9]{1,2})/|\.([0-9]{1,2})\.)([0-9]{4}|[0-9]{2})$"
    part = lambda p, *groups: "coalesce(" + ", ".join(f"nullif({d.extracted(text, p, g)}, '')" for g in groups) + ", null)"
    whole = lambda s: f"cast({s} as int)"
    month = f"(1 + floor((strpos('{''.join(v.MONTHS)}', {d.extracted(text, named, 2)}) - 1) / 3))" if not d.spark else f"(1 + floor((instr('{''.join(v.MONTHS)}', {d.extracted(text, named, 2)}) - 1) / 3))"
    named_year = f"coalesce({two_digit_year(whole(part(named, 3)))}, {year})"
    join = lambda y, m, n: d.date_of(f"concat({d.padded(y, 4)}, '-', {d.padded(m, 2)}, '-', {d.padded(n, 2)})")
    first, second = part(short, 1), part(short, 2, 3, 4)
    day, mon = (first, second) if day_first else (second, first)
    return d.first_case(
        [
            (d.matches(text, named), f"case when {named_year} is null then null else {join(f'cast({named_year} as int)', f'cast({month} as int)', whole(part(named, 1)))} end"),
            (d.matches(text, iso), join(whole(part(iso, 1)), whole(part(iso, 2, 4, 6)), whole(part(iso, 3, 5, 7)))),
            (d.matches(text, short), join(two_digit_year(whole(part(short, 5))), whole(mon), whole(day))),
        ]
    )


def parsed_amount(d: Dialect, x: str) -> str:
    """The decimal(18,2) value of an amount text, null if it has none: thousands commas, currency signs and codes and a
    closing CR or DR are ignored, parentheses make it negative."""
    text = d.replaced(f"upper(trim({x}))", r"(CR|DR)\s*$", "")
    text = f"trim({text})"
    digits = d.replaced(d.replaced(text, r"\b(AED|INR|USD|EUR|GBP)\b", ""), r"[^0-9.\-]", "")
    value = d.number(f"nullif({digits}, '')", "decimal(18,2)")
    bracketed = d.matches(text, r"^\(.*\)$")
    return f"(case when {bracketed} then -abs({value}) else {value} end)"


def marked_credit(d: Dialect, x: str) -> str:
    return d.matches(f"upper({x})", r"CR\s*$")


def marked_debit(d: Dialect, x: str) -> str:
    return d.matches(f"upper({x})", r"DR\s*$")


def signed_decimal(d: Dialect, x: str) -> str:
    """Like ``parsed_amount``, but a closing DR is negative as well."""
    return f"(case when {marked_debit(d, x)} then -abs({parsed_amount(d, x)}) else {parsed_amount(d, x)} end)"
